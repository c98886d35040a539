"""MinHash near-duplicates: one-permutation hashing, optimal densification, bands, stars and then all pairs left open.

Links join documents whose sets of distinct 5-word shingles have a Jaccard
similarity of at least 75 %, tested in integers on the full sets.

1. Sketch.  One hash per shingle: its high bits choose one of BANDS * ROWS
   bins, the smallest hash of a bin is its value.  An empty bin copies the
   first non-empty bin of its own pseudo-random bin sequence (optimal
   densification), so small sets are sketched as well as large ones.
2. Classes.  Rows with equal shingle sets form a class; only its smallest id
   goes on, so a group of copies of any size costs one row.
3. Stars.  A bucket (equal band values) first links its members to its smallest
   id; where that leaves several parts, to the member with the fullest buckets
   in all, which is the text most others come from.
4. The rest.  In a bucket still of several parts every other pair of members
   from two parts is compared, in tiles of salted blocks; nothing is capped.
5. Links are confirmed on full sets; components follow.

A pair at 75 % shares no band with probability (1 - 0.75**4)**32 < 6e-6; that
apart, two documents of a bucket are in one component or have been compared
(or are too different in size).

Nulls, empty texts and texts without words have an empty set and link with
nothing.  Repeated rows and repeated ids: rows with equal sets are one class; an
id with several texts keeps its rows, has the links of all of them, and joins
their components.  Rows without an id have themselves no id to give,
component_id is then null and kept false.  Extra input columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratawell.llm.arrow_map import map_batches, to_arrow_schema
from stratawell.llm.bytes_np import Words, distinct_pairs, mix, slices, utf8
from stratawell.llm.graph import components
from stratawell.session import drop, ship, stash

BANDS, ROWS, WIDTH = 32, 4, 5
BINS = BANDS * ROWS
PERCENT = 75
#: Members and shingles of a block of an open bucket, on average; a memory bound, results don't depend on it.
BLOCK, BLOCK_SHINGLES = 320, 1_000_000

_seq = np.random.default_rng(7).integers(0, BINS, (BINS, 64 * BINS))  # bin sequences of the empty bins


def _each(batch):
    data, offsets = utf8(batch.column(batch.num_columns - 1))
    for a, b in slices(offsets):
        row, shingle = distinct_pairs(*Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).shingles(WIDTH))
        yield a, b, row, shingle, np.bincount(row, minlength=b - a)


def sketch(row: np.ndarray, shingle: np.ndarray, rows: int) -> np.ndarray:
    """Densified bins (rows, BINS) of sorted distinct (row, shingle); rows without shingles stay 0."""
    bins = (shingle >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (bins[1:] != bins[:-1])
    value, full = np.zeros((rows, BINS), np.uint64), np.zeros((rows, BINS), bool)
    value[row[first], bins[first]], full[row[first], bins[first]] = shingle[first], True
    r, j = np.nonzero(~full & full.any(axis=1)[:, None])
    k = 0
    while len(r):
        source = _seq[j, k]
        hit = full[r, source]
        value[r[hit], j[hit]] = value[r[hit], source[hit]]
        r, j, k = r[~hit], j[~hit], k + 1
        if k == _seq.shape[1]:
            break
    return value


def band_keys(value: np.ndarray) -> np.ndarray:
    """One 64-bit key per band (rows, BANDS); equal band values in different bands get different keys."""
    v = value.reshape(len(value), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), v.shape[:2]).copy()
    for k in range(ROWS):
        h = mix(h * np.uint64(0xD1342543DE82EF95) + v[:, :, k])
    return h


def lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))


def sketches(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, fp1, fp2 (of the whole set) and the band keys of each row."""

    def make():
        def work(batch):
            for a, b, row, shingle, n in _each(batch):
                fp = fingerprints(shingle, n)
                keys = band_keys(sketch(row, shingle, b - a)).view(np.int64)
                yield {"id": batch.column(0).slice(a, b - a), "n_shingles": n, "fp1": fp[0], "fp2": fp[1], "bands": lists(keys.ravel(), np.full(b - a, BANDS))}

        return work

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("__text")), make, "id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, bands array<bigint>")


def fingerprints(shingle: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each row's set of shingles."""
    first, out = np.concatenate([[0], np.cumsum(n)]), []
    for salt in (0x1234567, 0x89ABCDF):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingle ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out


def full_sets(docs: DataFrame) -> DataFrame:
    """id, fp1, fp2 and sorted shingle set of docs(id, text)."""

    def make():
        def work(batch):
            for a, b, _, shingle, n in _each(batch):
                fp = fingerprints(shingle, n)
                yield {"id": batch.column(0).slice(a, b - a), "fp1": fp[0], "fp2": fp[1], "s": lists(shingle.view(np.int64), n)}

        return work

    return map_batches(docs, make, "id bigint, fp1 bigint, fp2 bigint, s array<bigint>")


def confirm(pairs: DataFrame, sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach PERCENT."""
    sized = pairs.join(sizes.select(F.col("id").alias("a"), F.col("n_shingles").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb")), "b")
    pairs = stash(sized.filter(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)"), "pairs")
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = both.select("a", "b", (F.size("sa") + F.size("sb")).cast("long").alias("total"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("both"))
    return shared.filter(f"100 * both >= {PERCENT} * (total - both)").select("a", "b")


def shared_counts(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, step: int = 4096) -> np.ndarray:
    """Size of the intersection of each set of x with each of y; sets of nx (ny) distinct values follow each other."""
    common = np.intersect1d(x, y)
    out = np.zeros((len(nx), len(ny)), np.int64)
    sides = []
    for flat, n in ((x, nx), (y, ny)):
        at = np.minimum(np.searchsorted(common, flat), max(len(common) - 1, 0))
        on = np.flatnonzero(common[at] == flat) if len(common) else np.zeros(0, np.int64)
        on = on[np.argsort(at[on], kind="stable")]
        sides.append((at[on], np.repeat(np.arange(len(n)), n)[on], len(n)))
    for c in range(0, len(common), step):
        field = []
        for col, row, rows in sides:
            a, b = np.searchsorted(col, (c, c + step))
            one = np.zeros((rows, min(step, len(common) - c)), np.float32)
            one[row[a:b], col[a:b] - c] = 1
            field.append(one)
        out += np.rint(field[0] @ field[1].T).astype(np.int64)
    return out


def tile_links(label: np.ndarray, n: np.ndarray, flat: np.ndarray, is_x: np.ndarray, is_y: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of labels that join all sets of x and y, with different labels, that reach PERCENT; a spanning forest of them."""
    if len(np.unique(label)) < 2:
        return []
    row = np.repeat(np.arange(len(n)), n)
    x, y = np.flatnonzero(is_x), np.flatnonzero(is_y)
    both = shared_counts(flat[is_x[row]], n[x], flat[is_y[row]], n[y])
    near = 100 * both >= PERCENT * (n[x][:, None] + n[y] - both)
    near &= label[x][:, None] != label[y]
    part, out = label.copy(), []
    for i in np.flatnonzero(near.any(axis=1)):
        for other in np.unique(part[y[near[i]]]):
            own = part[x[i]]
            if own != other:
                out.append((int(own), int(other)))
                part[part == other] = own
    return out


def rest_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the parts of members(key, id, part, n_shingles) that pairs of a bucket make.

    A bucket's members fall into k blocks by a hash; each pair of blocks is a task of its own.
    """
    from pyspark.sql.types import StructType

    ship(members.sparkSession)
    ddl = "a bigint, b bigint"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    split = members.groupBy("key").agg(F.min("part").alias("p1"), F.max("part").alias("p2"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("k"))
    split = stash(split.filter("p1 <> p2").select("key", "k"), "split")
    blocks = members.join(split, "key").join(sets, "id").withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("k")).cast("int"))
    tiles = blocks.select("key", "part", "s", "block", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    tiles = tiles.select("key", "part", "s", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def tile(table: pa.Table) -> pa.Table:
        s = table["s"].combine_chunks()
        block, i, j = table["block"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
        n = np.diff(s.offsets.to_numpy()).astype(np.int64)
        got = tile_links(table["part"].to_numpy(), n, s.flatten().to_numpy(), block == i, block == j)
        return pa.Table.from_arrays([pa.array([p[k] for p in got], pa.int64()) for k in (0, 1)], schema=schema)

    return tiles.groupBy("key", "i", "j").applyInArrow(tile, ddl)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id and kept for each row of docs."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    rows = stash(sketches(docs, id_col, text), "sketches")
    some = rows.filter("n_shingles > 0 AND id IS NOT NULL")
    kinds = some.groupBy("n_shingles", "fp1", "fp2").agg(F.min("id").alias("low"), F.first("bands").alias("bands"))
    # A class goes by its smallest id, or by a hash of its set where that id has several texts.
    several = stash(rows.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("low"), F.lit(True).alias("shared")), "several")
    repeats = not several.isEmpty()
    rep = F.when(F.col("shared"), F.xxhash64("n_shingles", "fp1", "fp2")).otherwise(F.col("low")).alias("rep")
    kinds = kinds.join(several, "low", "left") if repeats else kinds.withColumn("shared", F.lit(False))
    classes = stash(kinds.select("n_shingles", "fp1", "fp2", "low", rep, "bands"), "classes")
    flat = classes.select(F.col("rep").alias("id"), "n_shingles", F.explode("bands").alias("key"))
    buckets = stash(flat.groupBy("key").agg(F.min("id").alias("lo"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = stash(flat.join(buckets, "key").select("key", "id", "lo", "n", "n_shingles"), "members")
    sizes = classes.select(F.col("rep").alias("id"), "n_shingles")
    # Sets of the classes that share a bucket, from a text of the class's smallest id.
    weights = stash(members.groupBy("id").agg(F.sum("n").alias("weight")), "weights")
    used = classes.join(weights.select(F.col("id").alias("rep")), "rep", "left_semi").select(F.col("low").alias("id"), "fp1", "fp2", "rep")
    sets = full_sets(base.join(used.select("id").distinct() if repeats else used.select("id"), "id", "left_semi"))
    sets = sets.join(used, ["id", "fp1", "fp2"]).select(F.col("rep").alias("id"), "s").dropDuplicates(["id"]) if repeats else sets.select("id", "s")
    sets = stash(sets, "sets")
    first = stash(confirm(members.filter("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct(), sets, sizes), "first")
    near = stash(first.groupBy("b").agg(F.min("a").alias("hub")).select(F.col("b").alias("id"), "hub"), "near")
    # A further centre of buckets that the first round left in more than one part.
    named = stash(members.filter("n > 2").join(near, "id", "left").join(weights, "id").select("key", "id", "lo", "weight", "n_shingles", F.coalesce("hub", "id").alias("hub")), "named")
    centre = F.max(F.when(F.col("id") != F.col("lo"), F.struct("weight", "id")))["id"]
    open_ = stash(named.groupBy("key").agg(F.min("hub").alias("h1"), F.max("hub").alias("h2"), centre.alias("centre")).filter("h1 <> h2").select("key", "centre"), "open")
    left = stash(named.join(open_, "key").select("key", "id", "lo", "hub", "centre", "n_shingles"), "left")
    pairs = left.join(near.select(F.col("id").alias("centre"), F.col("hub").alias("chub")), "centre", "left").filter("id <> centre AND id <> lo AND hub <> coalesce(chub, centre)")
    pairs = pairs.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    second = confirm(pairs, sets, sizes)
    links = first.unionByName(second)
    if repeats:
        of_id = some.select("id", "n_shingles", "fp1", "fp2").join(several.select(F.col("low").alias("id")), "id", "left_semi").distinct()
        of_id = of_id.join(classes.select("n_shingles", "fp1", "fp2", "rep"), ["n_shingles", "fp1", "fp2"])
        links = links.unionByName(of_id.join(of_id.groupBy("id").agg(F.min("rep").alias("a")), "id").filter("a <> rep").select("a", F.col("rep").alias("b")))
    found = components(links)
    # All pairs of what is still in several parts.
    parts = left.filter("id <> lo AND id <> centre").join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    rest = stash(rest_links(stash(parts.select("key", "id", "n_shingles", F.coalesce("component", "id").alias("part")), "parts"), sets).distinct(), "rest")
    if not rest.isEmpty():
        joined = components(rest).select(F.col("node").alias("part"), F.col("component").alias("whole"))
        every = found.select(F.col("node"), F.col("component").alias("part")).unionByName(joined.join(found.select(F.col("node").alias("part")), "part", "left_anti").select(F.col("part").alias("node"), "part"))
        found = stash(every.join(joined, "part", "left").select("node", F.coalesce("whole", "part").alias("component")), "found")
    # A component goes by the smallest id of all its classes.
    of_class = classes.select("n_shingles", "fp1", "fp2", "low", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    if repeats:
        lows = of_class.groupBy("component").agg(F.min("low").alias("whole_low"))
        of_class = of_class.join(lows.filter("component IS NOT NULL"), "component", "left").withColumn("component", F.col("whole_low"))
    of_class = stash(of_class.select("n_shingles", "fp1", "fp2", F.coalesce("component", "low").alias("component_id")), "of_class")
    out = rows.select("id", "n_shingles", "fp1", "fp2").join(of_class, ["n_shingles", "fp1", "fp2"], "left")
    if repeats:  # a text without words belongs to its id's component
        by_id = out.select("id", F.coalesce("component_id", "id").alias("c")).join(several.select(F.col("low").alias("id")), "id", "left_semi").groupBy("id").agg(F.min("c").alias("c"))
        out = out.join(stash(by_id, "by_id"), "id", "left").withColumn("component_id", F.coalesce("c", "component_id"))
    drop(classes, buckets, members, weights, sets, first, near, named, open_, left, rest, several)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of docs whose id is the smallest of its group, repeated rows once; rows without an id all stay."""
    docs = docs.filter("doc_id IS NOT NULL"), docs.filter("doc_id IS NULL")
    kept = stash(near_duplicates(docs[0]).filter("kept").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    # Only texts of repeated ids are shuffled.
    single = docs[0].join(kept.filter("n = 1").select("doc_id"), "doc_id", "left_semi")
    several = docs[0].join(kept.filter("n > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates()
    return single.unionByName(several).unionByName(docs[1])


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Exact components by brute force over shared shingles; \x20 and \x09-\x0D are the separators.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)
), e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e2.b, r.c FROM r JOIN e2 ON e2.a = r.doc_id WHERE r.c < e2.b
), c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
