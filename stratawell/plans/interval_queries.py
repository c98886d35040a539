"""Interval queries on sessions, shipping windows and part-derived coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratawell.operators import events as ev, ranges
from stratawell.plans.registry import query, r

SESSION_SQL = "s AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 10) AS BIGINT) AS \"end\", value FROM events)"
BIN = 600


def sessions(t):
    at = F.unix_timestamp("ts")
    return t("events").select("event_id", "user_id", "event_type", at.alias("start"), (at + F.floor(F.col("value") * 10)).alias("end"), "value")


@query(f"WITH {SESSION_SQL} SELECT a.event_id, b.event_id AS event_id_2 FROM s a JOIN s b ON a.user_id = b.user_id AND a.start <= b.\"end\" AND b.start <= a.\"end\"")
def interval_overlap(t):
    s = sessions(t)
    return ranges.overlap_join(s, s, ["user_id"], BIN).select("event_id", "event_id_2")


@query(f"WITH {SESSION_SQL} SELECT a.event_id FROM s a JOIN s b ON a.user_id = b.user_id AND a.start <= b.\"end\" AND b.start <= a.\"end\" GROUP BY a.event_id HAVING count(*) = 1")
def interval_unique_hit(t):
    s = sessions(t)
    return ranges.only_own_hit(s, s, ["user_id"], "event_id", BIN)


@query(f"WITH {SESSION_SQL} SELECT a.event_id, b.event_id AS event_id_2 FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.start <= b.\"end\" + 301 AND b.start <= a.\"end\" + 301")
def interval_within_gap(t):
    s = sessions(t)
    return ranges.overlap_join(s, s, ["user_id"], BIN, gap=300).filter("event_id < event_id_2").select("event_id", "event_id_2")


@query("SELECT o_orderkey, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem JOIN orders ON o_orderkey % 500 = l_orderkey % 500 AND date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) BETWEEN date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AND date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + 30 GROUP BY o_orderkey")
def point_in_interval(t):
    day = lambda c: F.date_diff(F.to_date(c), F.lit("1990-01-01").cast("date"))
    p = t("lineitem").select((F.col("l_orderkey") % 500).alias("k"), day("l_shipdate").alias("at"), "l_quantity")
    o = t("orders").select((F.col("o_orderkey") % 500).alias("k"), "o_orderkey", day("o_orderdate").alias("start"), (day("o_orderdate") + 30).alias("end"))
    return ranges.points_in(p, o, ["k"], "at", 60).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query(f"""WITH {SESSION_SQL}, g AS (SELECT DISTINCT user_id, start - start % 7200 AS a FROM s), w AS (SELECT user_id, a AS start, a + 3599 AS "end", user_id || ':' || a AS name FROM g)
SELECT w.name, 3600 AS size, coalesce(sum(least(w."end", s."end") - greatest(w.start, s.start) + 1) FILTER (s.start IS NOT NULL), 0)::BIGINT AS covered, round(coalesce(sum((least(w."end", s."end") - greatest(w.start, s.start) + 1) * value), 0), 3) AS sum,
  round(coalesce(sum((least(w."end", s."end") - greatest(w.start, s.start) + 1) * value), 0) / 3600, 6) AS mean0, round(sum((least(w."end", s."end") - greatest(w.start, s.start) + 1) * value) / sum(least(w."end", s."end") - greatest(w.start, s.start) + 1) FILTER (s.start IS NOT NULL), 6) AS mean, min(value) AS min, max(value) AS max
FROM w LEFT JOIN s ON s.user_id = w.user_id AND s.start <= w."end" AND w.start <= s."end" GROUP BY w.name""")
def interval_signal_summary(t):
    s = sessions(t)
    w = s.select("user_id", (F.col("start") - F.col("start") % 7200).alias("start")).distinct().select("user_id", "start", (F.col("start") + 3599).alias("end"), F.concat("user_id", F.lit(":"), "start").alias("name"))
    out = ranges.signal_summary(s.select("user_id", "start", "end", "value"), w, ["user_id"], "name", 3600)
    return out.withColumns({"sum": r(F.col("sum"), 3), "mean0": r(F.col("mean0")), "mean": r(F.col("mean"))})


PART_SQL = "p AS (SELECT p_partkey, p_partkey * 100 AS s, p_partkey * 100 + p_size AS e, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part)"


def coordinates(t):
    k = F.col("p_partkey")
    return t("part").select("p_partkey", (k * 100).alias("s"), (k * 100 + F.col("p_size")).alias("e"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"))


@query(f"WITH {PART_SQL} SELECT p_partkey, e - s + 1 AS width, CASE WHEN strand = '+' THEN s - 50 ELSE e + 1 END AS up_start, CASE WHEN strand = '+' THEN s - 1 ELSE e + 50 END AS up_end, CASE WHEN strand = '+' THEN e + 1 ELSE s - 50 END AS down_start, CASE WHEN strand = '+' THEN e + 50 ELSE s - 1 END AS down_end, CASE WHEN strand = '+' THEN s - 3 ELSE e - 5 END AS five_start, CASE WHEN strand = '+' THEN s + 5 ELSE e + 3 END AS five_end FROM p")
def flank_arithmetic(t):
    s, e, strand = F.col("s"), F.col("e"), F.col("strand")
    up_s, up_e, down_s, down_e = ranges.flanks(strand, s - 50, s - 1, e + 1, e + 50)
    five = ranges.five_prime_window(strand, s, e, 3, 6)
    return coordinates(t).select("p_partkey", ranges.width_of(s, e).alias("width"), up_s.alias("up_start"), up_e.alias("up_end"), down_s.alias("down_start"), down_e.alias("down_end"), five[0].alias("five_start"), five[1].alias("five_end"))


ID_SQL = """i AS (SELECT p_partkey AS id, p_partkey % 5 AS kind, p_partkey * 1000 AS a, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'G' || p_partkey || CASE WHEN p_partkey % 13 = 0 THEN '_G2' ELSE '' END AS gene FROM part)"""


def event_ids(t):
    k = F.col("p_partkey")
    a = k * 1000
    strand = F.when(k % 2 == 0, "+").otherwise("-")
    gene = F.concat(F.lit("G"), k, F.when(k % 13 == 0, "_G2").otherwise(""))
    n = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else (a + y).cast("string") for y in x])
    places = (
        F.when(k % 5 == 0, n(0, "-", 100, ":", 160, "-", 300)).when(k % 5 == 1, n(0, ":", 100, "-", 200, ":", 300))
        .when(k % 5 == 2, n(0, "-", 100, ":", 0, "-", 130)).when(k % 5 == 3, n(0, "-", 50, ":", 70, "-", 300, ":", 0, "-", 120, ":", 160, "-", 300)).otherwise(n(0, ":", 50, "-", 200, ":", 100, ":", 150, "-", 200))
    )
    kind = F.element_at(F.array(*map(F.lit, ("SE", "RI", "A3", "MX", "AF"))), (k % 5 + 1).cast("int"))
    return t("part").select(k.alias("id"), F.concat(gene, F.lit(";"), kind, F.lit(":chr1:"), places, F.lit(":"), strand).alias("event_id"))


@query(f"""WITH {ID_SQL} SELECT id, gene AS gene_id, ['SE', 'RI', 'A3', 'MX', 'AF'][kind + 1] AS event_type, strand, NOT contains(gene, '_') AS single_gene,
  CASE kind WHEN 0 THEN a WHEN 1 THEN a WHEN 2 THEN a + 1 WHEN 3 THEN a + 1 ELSE CASE WHEN strand = '+' THEN a ELSE a + 1 END END AS all_start,
  CASE kind WHEN 0 THEN a + 300 WHEN 1 THEN a + 300 WHEN 2 THEN a + 129 WHEN 3 THEN a + 299 ELSE CASE WHEN strand = '+' THEN a + 199 ELSE a + 200 END END AS all_end,
  CASE kind WHEN 0 THEN a + 100 WHEN 1 THEN a + 101 END AS event_start, CASE kind WHEN 0 THEN a + 160 WHEN 1 THEN a + 199 END AS event_end,
  CASE kind WHEN 0 THEN CASE WHEN strand = '+' THEN a + 1 ELSE a + 161 END WHEN 1 THEN CASE WHEN strand = '+' THEN a ELSE a + 200 END END AS upstream_start,
  CASE kind WHEN 0 THEN CASE WHEN strand = '+' THEN a + 99 ELSE a + 299 END WHEN 1 THEN a + 300 END AS upstream_end,
  CASE kind WHEN 0 THEN CASE WHEN strand = '+' THEN a + 161 ELSE a + 1 END WHEN 1 THEN CASE WHEN strand = '+' THEN a + 200 ELSE a END END AS downstream_start,
  CASE kind WHEN 0 THEN CASE WHEN strand = '+' THEN a + 299 ELSE a + 99 END WHEN 1 THEN CASE WHEN strand = '+' THEN a + 300 ELSE a + 100 END END AS downstream_end FROM i""")
def event_id_parse(t):
    names = ["all", "event", "upstream", "downstream"]
    return ev.parsed(event_ids(t)).select("id", "gene_id", "event_type", "strand", "single_gene", *[f"{n}_{x}" for n in names for x in ("start", "end")])


@query(f"""WITH {ID_SQL}, e AS (SELECT * FROM i WHERE kind = 0) SELECT id::VARCHAR AS name, 'event_name' AS region, id, a + 100 AS start, a + 160 AS "end" FROM e
UNION ALL SELECT 'up_' || id, 'upstream_other_region', id, CASE WHEN strand = '+' THEN a + 1 ELSE a + 161 END, CASE WHEN strand = '+' THEN a + 99 ELSE a + 299 END FROM e
UNION ALL SELECT 'down_' || id, 'downstream_other_region', id, CASE WHEN strand = '+' THEN a + 161 ELSE a + 1 END, CASE WHEN strand = '+' THEN a + 299 ELSE a + 99 END FROM e""")
def regions_of_interest(t):
    e = ev.parsed(event_ids(t)).filter("event_type = 'SE'")
    region, id_ = ev.region_of(F.col("name"))
    return ev.regions(e).select("name", region.alias("region"), id_.alias("id"), "start", "end")


@query("SELECT l_orderkey, l_linestatus, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS psi FROM lineitem GROUP BY ALL")
def psi_ratio(t):
    l = t("lineitem").withColumn("transcript_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"))
    alt = F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("transcript_id")))
    members = l.groupBy(F.col("l_orderkey").alias("event_id"), F.col("l_linestatus").alias("st")).agg(alt.alias("alternative"), F.collect_set("transcript_id").alias("total"))
    abundance = l.groupBy(F.col("l_linestatus").alias("sample_id"), "transcript_id").agg(F.sum("l_quantity").alias("tpm"))
    out = ev.psi(members.withColumn("event_id", F.concat_ws("|", "event_id", "st")), abundance)
    return out.filter(F.element_at(F.split("event_id", r"\|"), 2) == F.col("sample_id")).select(F.element_at(F.split("event_id", r"\|"), 1).cast("long").alias("l_orderkey"), F.col("sample_id").alias("l_linestatus"), r(F.col("psi")).alias("psi"))
