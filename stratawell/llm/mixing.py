"""Mixing sources to target weights with a low-discrepancy schedule.

Targets: source i gets min(3 * size_i, level * weight_i) with the level that
makes them sum to all sizes, in closed form over the sources sorted by
capacity / weight (equal to resharing the excess until none is above).

Schedule: the mix is a line of slots, blocks of equal numbers of words.  Slot k
belongs to the source in whose share of the cumulative targets the golden-ratio
point frac(k * phi) falls; slots are ranked per source.  A source's documents,
shuffled by the MD5 of their ids, form a stream of words that is passed through
up to three times; the source's rank-r slot takes words [r, r + 1) * block of
it.  So a source takes what its slots hold: its target but for the few blocks by
which the points miss its share, and nothing beyond three times its size.

The block is the smallest target / FINE, at most BLOCK words, and long enough
that the schedule has at most max(LEAST_SLOTS, 4 * documents) slots.  So a
source's taken words miss its target by some blocks, below 1 % unless the source
is smaller than about FINE / LEAST_SLOTS of all.

Prefix sums and ranks have two levels (hash prefix or slot range, then rows), so
a source of any size is spread over many tasks.  Nulls: a null text has size 0,
a null source is a source of its own and the last one; a null id hashes as "".
Repeated rows are documents of their own.  Documents of size 0 take 0 words.
An empty table gives an empty result.  Extra input columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stratawell.session import drop, stash

BLOCK, FINE, LEAST_SLOTS = 1024, 1024, 1 << 20
REPEATS, WEIGHTS = 3, (1, 2, 3)
GOLDEN = 2654435769  # 2**32 / golden ratio
CELLS, RANGE = 4096, 4096


def n_words(text: Column) -> Column:
    """The number of words of a text, 0 for NULL: each becomes one mark, what separates them goes.

    The text is only passed over, so memory is a few times the longest text; no list of words is made.
    """
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def word_counts(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and size, the number of words of the text."""
    return docs.select(*keys, n_words(F.col(text)).alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """sk (source key), source_size, target and place of each source; a row per source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") - 1) % len(WEIGHTS) + 1).cast("long"))
    everything = W.orderBy(F.col("source_size") / F.col("weight"), "place")
    before, all_ = everything.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(all_) - REPEATS * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("rest", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", F.col("left").cast("double") / F.col("rest"))
    free = REPEATS * F.col("source_size") >= F.col("level") * F.col("weight")
    s = s.withColumn("level", F.first(F.when(free, F.col("level")), ignorenulls=True).over(everything.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    share = F.least(F.lit(float(REPEATS)) * F.col("source_size"), F.col("level") * F.col("weight"))
    return s.select(source_key().alias("sk"), "source", "place", "source_size", share.alias("target"))


def source_key() -> Column:
    """A non-null join key of the source."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))


def block_words(goal: DataFrame, documents: int) -> tuple[int, int]:
    """Words of a slot, and the number of slots of the schedule."""
    least, total = goal.agg(F.min(F.when(F.col("target") > 0, F.col("target"))), F.sum("source_size")).first()
    if not total:
        return 1, 0
    block = max(1, min(BLOCK, int(least) // FINE), -(-total // max(LEAST_SLOTS, 4 * documents)))
    return block, (2 * total + block) // (2 * block)


def slots(goal: DataFrame, n: int) -> DataFrame:
    """slot, sk and rank (of the slot among its source's) of a schedule of n slots."""
    spark = goal.sparkSession
    total = W.partitionBy()
    run = W.orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    # Shares in 2**32ths, from whole words, so that any engine gets the same.
    words = goal.filter("target > 0").select("sk", "place", F.floor(F.col("target") + 0.5).cast("long").alias("w"))
    edge = lambda c: F.floor(c.cast("double") / F.sum("w").over(total).cast("double") * float(1 << 32))
    share = words.select("sk", edge(F.sum("w").over(run) - F.col("w")).alias("lo"), edge(F.sum("w").over(run)).alias("hi")).filter("lo < hi")
    # Cells make the interval lookup an equi-join.
    wide = (1 << 32) // CELLS
    share = share.select("sk", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / wide), F.floor((F.col("hi") - 1) / wide))).alias("cell"))
    k = F.col("id") % (1 << 31)
    lap = F.floor(F.col("id") / (1 << 31)) * ((GOLDEN * (1 << 31)) % (1 << 32))
    point = ((k * GOLDEN) % (1 << 32) + lap) % (1 << 32)
    line = spark.range(n).select(F.col("id").alias("slot"), point.alias("x")).withColumn("cell", F.floor(F.col("x") / wide))
    owned = line.join(share, "cell").filter("x >= lo AND x < hi").select("slot", "sk", F.floor(F.col("slot") / RANGE).alias("part"))
    owned = stash(owned, "slots")
    before = owned.groupBy("sk", "part").agg(F.count("*").alias("n"))
    before = before.select("sk", "part", (F.sum("n").over(W.partitionBy("sk").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("base"))
    inside = owned.withColumn("i", F.row_number().over(W.partitionBy("sk", "part").orderBy("slot")) - 1)
    return inside.join(before, ["sk", "part"]).select("slot", "sk", (F.col("base") + F.col("i")).alias("rank"))


def placed(sizes: DataFrame, documents: int) -> DataFrame:
    """sizes with at, a document's first word in its source's shuffled stream; sizes has rid, doc_id, sk, size."""
    digits = min(8, max(1, math.ceil(math.log(max(documents, 1) / 256 + 1, 16))))
    m = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sizes.withColumn("m", m).withColumn("head", F.substring("m", 1, digits))
    before = rows.groupBy("sk", "head").agg(F.sum("size").alias("n"))
    before = before.select("sk", "head", (F.sum("n").over(W.partitionBy("sk").orderBy("head").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("base"))
    run = W.partitionBy("sk", "head").orderBy("m", "doc_id", "size", "rid").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = rows.withColumn("i", F.sum("size").over(run) - F.col("size"))
    return inside.join(before, ["sk", "head"]).select("rid", "doc_id", "sk", "size", (F.col("base") + F.col("i")).alias("at"))


def mix(sizes: DataFrame, goal: DataFrame, schedule=slots) -> DataFrame:
    """The mix: slot, rid, doc_id, pass, from_word and to_word of each piece of a document in a slot.

    schedule(goal, n) gives the owner and rank of each of n slots; a piece exists only where a slot takes it.
    """
    documents = sizes.count()
    block, n = block_words(goal, documents)
    slot = stash(schedule(goal, n), "schedule")
    held = slot.groupBy("sk").agg((F.max("rank") + 1).alias("held"))
    docs = placed(sizes, documents).filter("size > 0").join(goal.select("sk", "source_size").join(held, "sk"), "sk")
    turn = docs.select("*", F.explode(F.array(*map(F.lit, range(REPEATS)))).alias("pass"))
    turn = turn.withColumn("start", F.col("at") + F.col("pass") * F.col("source_size")).withColumn("stop", F.least(F.col("start") + F.col("size"), F.col("held") * block)).filter("start < stop")
    piece = turn.select("*", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))).alias("rank"))
    piece = piece.withColumn("a", F.greatest("start", F.col("rank") * block)).withColumn("z", F.least("stop", (F.col("rank") + 1) * block))
    return piece.join(slot, ["sk", "rank"]).select("slot", "sk", "rid", "doc_id", "pass", (F.col("a") - F.col("start")).alias("from_word"), (F.col("z") - F.col("start")).alias("to_word"))


def sized(docs: DataFrame) -> DataFrame:
    """rid, doc_id, source, sk and size of each document, in a table of its own so that rid stays."""
    keyed = docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("rid"))
    return stash(word_counts(keyed, ["rid", "doc_id", "source"]).withColumn("sk", source_key()), "sizes")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them, in the order of their first slots: a row per document and pass.

    The text is cut to the words taken where that is not all; a cut text is its words joined by single
    spaces, n_chars its length.
    """
    columns = docs.columns
    docs = stash(docs.withColumn("__rid", F.monotonically_increasing_id()), "docs")
    sizes = stash(word_counts(docs.select(F.col("__rid").alias("rid"), "doc_id", "source", "text"), ["rid", "doc_id", "source"]).withColumn("sk", source_key()), "sizes")
    spans = mix(sizes, stash(targets(sizes), "targets")).groupBy("rid", "pass").agg(F.min("from_word").alias("__from"), F.max("to_word").alias("__to"), F.min("slot").alias("__slot"))
    spans = stash(spans.join(sizes.select("rid", F.col("size").alias("__size")), "rid").withColumnRenamed("rid", "__rid").drop("pass"), "spans")
    drop(sizes)
    whole = (F.col("__from") == 0) & (F.col("__to") == F.col("__size"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, (F.col("__from") + 1).cast("int"), (F.col("__to") - F.col("__from")).cast("int")), " ")
    out = docs.join(spans, "__rid").withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.orderBy("__slot", "__rid", "__from").select(*columns)


def op5_golden_mix(spark, sf_dir: str) -> DataFrame:
    return source_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def source_mix(docs: DataFrame, schedule=slots) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_slot (null where nothing is taken) of each document."""
    sizes = sized(docs.select("doc_id", "source", "text"))
    goal = stash(targets(sizes), "targets")
    taken = mix(sizes, goal, schedule).groupBy("rid").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"))
    return sizes.join(goal.select("sk", "source_size", "target"), "sk").join(taken, "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), p AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place FROM s
), w AS (SELECT *, 1 + (place - 1) % 3 AS weight FROM p
), l AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT arg_min(level, (source_size::DOUBLE / weight, place)) AS level FROM l WHERE 3 * source_size >= level * weight
), t AS (
  SELECT w.source, source_size, place, least(3.0::DOUBLE * source_size, f.level * weight) AS target FROM w, f
), b AS (  -- words of a slot, and slots
  SELECT block, (2 * total + block) // (2 * block) AS n FROM (
    SELECT total, greatest(1, least(1024, floor(least_target)::BIGINT // 1024), (total + slots_most - 1) // slots_most) AS block FROM (
      SELECT sum(source_size)::BIGINT AS total, min(CASE WHEN target > 0 THEN target END) AS least_target, greatest(1048576, 4 * (SELECT count(*) FROM d)) AS slots_most FROM t))
), e AS (  -- each source's interval of the points, in 2**32ths
  SELECT source, floor((sum(w) OVER o - w)::DOUBLE / sum(w) OVER ()::DOUBLE * 4294967296.0::DOUBLE)::BIGINT AS lo, floor(sum(w) OVER o::DOUBLE / sum(w) OVER ()::DOUBLE * 4294967296.0::DOUBLE)::BIGINT AS hi
  FROM (SELECT source, place, floor(target + 0.5)::BIGINT AS w FROM t WHERE target > 0) WINDOW o AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), k AS (  -- slot k has the golden-ratio point frac(k * 2654435769 / 2**32)
  SELECT range AS slot, ((range::HUGEINT * 2654435769) % 4294967296)::BIGINT AS x FROM range((SELECT n FROM b))
), o AS (
  SELECT k.slot, e.source, row_number() OVER (PARTITION BY e.source ORDER BY k.slot) - 1 AS rank FROM k JOIN e ON k.x >= e.lo AND k.x < e.hi
), h AS (SELECT source, count(*) * (SELECT block FROM b) AS held FROM o GROUP BY source
), q AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, coalesce(h.held, 0) AS held,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN h ON h.source IS NOT DISTINCT FROM d.source
)
SELECT q.doc_id, q.size::BIGINT AS size, source_size, target,
  (greatest(0, least(size, held - pos)) + greatest(0, least(size, held - pos - source_size)) + greatest(0, least(size, held - pos - 2 * source_size)))::BIGINT AS taken,
  o.slot AS first_slot
FROM q LEFT JOIN o ON o.source IS NOT DISTINCT FROM q.source AND o.rank = q.pos // (SELECT block FROM b) AND q.size > 0
"""
