"""Readers and writers as queries: a table is written in a format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratawell.operators import events, reshape
from stratawell.plans.registry import query, r
from stratawell.session import scratch
from stratawell.sources import readers, writers


def put(df, tag, line, head=None):
    """Text lines of df in one file of a new shared folder, under a head line."""
    spark = df.sparkSession
    path, body = scratch(spark, tag), df.select(line.alias("value"), F.lit(1).alias("place"))
    if head is not None:
        body = body.union(spark.createDataFrame([(head, 0)], "value string, place int"))
    body.repartition(1).sortWithinPartitions("place").select("value").write.text(path)
    return path


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS c_acctbal FROM customer")
def csv_round_trip(t):
    c = t("customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")).alias("c_acctbal"))
    path = scratch(c.sparkSession, "csv")
    writers.csv(c.withColumn("c_acctbal", F.coalesce(F.col("c_acctbal").cast("string"), F.lit("NA"))), path)
    return readers.delimited(c.sparkSession, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def remembered_table(t):
    o = t("orders").select("o_orderkey", "o_totalprice")
    path = scratch(o.sparkSession, "memo")
    writers.remembered(o.sparkSession, path, lambda: o)
    return writers.remembered(o.sparkSession, path, lambda: o.limit(0))


STATES_SQL = "states AS (SELECT 'chr' || s_nationkey AS seqnames, s_suppkey * 37 % 5000 + 1 AS start, s_suppkey * 37 % 5000 + 20 + s_suppkey % 60 AS end_, 'S' || s_suppkey % 4 AS state FROM supplier)"


def states(t):
    s, k = t("supplier"), F.col("s_suppkey")
    made = s.select(F.concat(F.lit("chr"), F.col("s_nationkey").cast("string")).alias("seqnames"), (k * 37 % 5000 + 1).alias("start"), (k * 37 % 5000 + 20 + k % 60).alias("end"), F.concat(F.lit("S"), (k % 4).cast("string")).alias("name"))
    path = scratch(s.sparkSession, "bed")
    writers.bed(made, path)
    return readers.bed(s.sparkSession, path)


@query(f"WITH {STATES_SQL} SELECT seqnames, start, end_ AS \"end\", state, 'chromhmm_' || row_number() OVER (ORDER BY seqnames, start, end_, state) AS name FROM states")
def indexed_states(t):
    return readers.indexed(states(t))


@query(f"""WITH {STATES_SQL}, n AS (SELECT *, 'chromhmm_' || row_number() OVER (ORDER BY seqnames, start, end_, state) AS name FROM states
), e AS (SELECT c_custkey::VARCHAR AS name, 'chr' || c_nationkey AS seqnames, c_custkey * 13 % 5000 + 1 AS start, c_custkey * 13 % 5000 + 1 + c_custkey % 90 AS end_ FROM customer WHERE c_custkey % 3 = 0
), a AS (SELECT name, seqnames, start, end_ FROM e UNION ALL SELECT 'up_' || name, seqnames, start - 50, start - 1 FROM e)
SELECT name, seqnames, start, end_ AS "end" FROM a UNION ALL
SELECT DISTINCT n.name, n.seqnames, n.start, n.end_ FROM n JOIN e ON n.seqnames = e.seqnames AND n.start - e.end_ - 1 <= 30 AND e.start - n.end_ - 1 <= 30""")
def nearby_state_regions(t):
    k = F.col("c_custkey")
    e = t("customer").filter(k % 3 == 0).select(k.cast("string").alias("name"), F.concat(F.lit("chr"), F.col("c_nationkey").cast("string")).alias("seqnames"), (k * 13 % 5000 + 1).alias("start"), (k * 13 % 5000 + 1 + k % 90).alias("end"))
    up = e.select(F.concat(F.lit("up_"), "name").alias("name"), "seqnames", (F.col("start") - 50).alias("start"), (F.col("start") - 1).alias("end"))
    return events.with_nearby_states(e.unionByName(up), readers.indexed(states(t)), 30, 200)


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand, (l_partkey % 500)::DOUBLE AS a, (l_suppkey % 7)::DOUBLE AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN v > 0 THEN log2(v) END, 6) AS distance_tss, round(CASE WHEN w > 0 THEN log2(w) END, 6) AS distance_tes FROM (SELECT *, CASE WHEN strand = '-' THEN b ELSE a END AS v, CASE WHEN strand = '-' THEN a ELSE b END AS w FROM x)""")
def strand_end_distances(t):
    strand = F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("+")
    x = t("lineitem").select("l_orderkey", "l_linenumber", strand.alias("strand"), (F.col("l_partkey") % 500 + 1000).alias("start"), F.lit(2000).alias("end"), F.lit(1000).alias("gene_start"), (2000 + F.col("l_suppkey") % 7).alias("gene_end"))
    d = events.end_distances(x)
    finite = lambda c: r(F.when(F.col(c) > float("-inf"), F.col(c))).alias(c)
    return d.select("l_orderkey", "l_linenumber", finite("distance_tss"), finite("distance_tes"))


@query("SELECT 'chr' || (p_partkey % 9) AS seqnames, 'transcript' AS type, p_partkey AS start, p_partkey + p_size AS \"end\", CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '+' END AS strand, 'G' || p_size AS gene_id, 'T' || p_partkey AS transcript_id FROM part WHERE p_partkey % 3 < 2")
def annotation_read(t):
    p, k = t("part"), F.col("p_partkey")
    text = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    s = lambda c: c.cast("string")
    notes = text('gene_id "G', s(F.col("p_size")), '"; transcript_id "T', s(k), '"; transcript_support_level "', s(k % 3 + 1), ' (assigned)";')
    strand = F.when(k % 2 == 0, "-").otherwise("+")
    line = F.concat_ws("\t", text("chr", s(k % 9)), F.lit("src"), F.lit("transcript"), s(k), s(k + F.col("p_size")), F.lit("."), strand, F.lit("."), notes)
    path = put(p, "gtf", line, "#!made")
    return readers.gtf(p.sparkSession, path, ["gene_id", "transcript_id"], ["1", "2"])


@query("""WITH s AS (SELECT 'chr' || n_nationkey AS name, repeat(substr('ACGTTGCAAGGCTA', 1 + n_nationkey % 7), 40) AS seq FROM nation
), w AS (SELECT c_custkey, 'chr' || c_nationkey AS name, 1 + c_custkey % 200 AS start, c_custkey % 200 + 1 + c_custkey % 90 AS end_, CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE '+' END AS strand FROM customer)
SELECT c_custkey, CASE WHEN strand = '-' THEN reverse(translate(substr(seq, start, end_ - start + 1), 'ACGT', 'TGCA')) ELSE substr(seq, start, end_ - start + 1) END AS seq FROM w JOIN s ON s.name = w.name""")
def window_sequences(t):
    n = t("nation").select(F.concat(F.lit("chr"), F.col("n_nationkey").cast("string")).alias("name"), F.repeat(F.expr("substr('ACGTTGCAAGGCTA', 1 + n_nationkey % 7)"), F.lit(40)).alias("seq"))
    path = scratch(n.sparkSession, "fasta")
    writers.fasta(n, path)
    chunks = readers.sequence_chunks(readers.fasta(n.sparkSession, path), 30, 5)
    k = F.col("c_custkey")
    w = t("customer").select(k, F.concat(F.lit("chr"), F.col("c_nationkey").cast("string")).alias("seqnames"), (1 + k % 200).alias("start"), (k % 200 + 1 + k % 90).alias("end"), F.when(k % 2 == 0, "-").otherwise("+").alias("strand"))
    return readers.subsequences(w, chunks, 30).select("c_custkey", "seq")


@query("SELECT o_custkey AS position, 'p' || right(o_orderpriority, 3) AS sample_id, max(o_totalprice) AS score FROM orders GROUP BY ALL")
def methylation_long(t):
    o = t("orders").withColumn("sample_id", F.concat(F.lit("p"), F.expr("right(o_orderpriority, 3)")))
    names = sorted(x[0] for x in o.select("sample_id").distinct().collect())
    wide = reshape.to_wide(o, ["o_custkey"], "sample_id", "o_totalprice", names, fill=-1.0)
    path = scratch(o.sparkSession, "methylation")
    writers.csv(wide, path, compressed=False)
    return readers.methylation(o.sparkSession, path)


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT 'SE' AS event_type, l_orderkey::VARCHAR AS event_id, '[' || string_agg(l_linenumber::VARCHAR, ', ' ORDER BY l_linenumber) || ']' AS total, count(*) FILTER (l_linenumber > 1) AS others FROM d GROUP BY l_orderkey""")
def event_member_lists(t):
    m = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).cast("array<string>").alias("total"))
    line = F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.lit("1"), F.array_join("total", ","))
    path = put(m, "members", line, "event_id\talternative_transcripts\ttotal_transcripts")
    got = readers.event_members(m.sparkSession, {"SE": path})
    return got.select("event_type", "event_id", F.concat(F.lit("["), F.array_join("total", ", "), F.lit("]")).alias("total"), F.size("other").cast("bigint").alias("others"))


@query("SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 4.0 END AS score FROM nation")
def sequence_scores(t):
    n = t("nation")
    path = put(n.filter("n_nationkey % 2 = 0"), "scores", F.concat_ws("\t", "n_name", (F.col("n_nationkey") / 4.0).cast("double").cast("string")))
    return readers.scores(n.sparkSession, path, n.select("n_name"), key="n_name")
