"""Correlation, dispersion, ranking and reshaping queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from stratawell.functions.safe_math import padded_dispersion, round_even, safe_corr
from stratawell.operators import relational as rel, reshape, stats
from stratawell.operators.ordered import ranged, running, with_totals
from stratawell.plans.registry import query, r

FEATURES = ["l_quantity", "l_discount", "l_tax"]
GROUP = ["l_returnflag", "l_linestatus"]
MINIMUM = 50

LONG_SQL = """long AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus, l_extendedprice, l_tax AS control, 'l_quantity' AS feature, l_quantity AS value FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus, l_extendedprice, l_tax, 'l_discount', l_discount FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus, l_extendedprice, l_tax, 'l_tax', l_tax FROM lineitem)"""
CORR = "CASE WHEN stddev_samp({x}) * stddev_samp({y}) > 0 THEN covar_samp({x}, {y}) / (stddev_samp({x}) * stddev_samp({y})) END"
CORR_VY = CORR.format(x="value", y="l_extendedprice")
CORR_SQL = f"WITH {LONG_SQL}, c AS (SELECT l_returnflag, l_linestatus, feature, CASE WHEN count(*) >= {MINIMUM} THEN {CORR_VY} END AS r, count(*) AS n FROM long GROUP BY ALL)"


def long(t):
    return reshape.to_long(t("lineitem"), ["l_orderkey", "l_linenumber", "l_suppkey", *GROUP, "l_extendedprice"], FEATURES)


def group_correlations(t):
    return stats.correlations(long(t), GROUP, "l_extendedprice", MINIMUM)


@query(CORR_SQL + " SELECT l_returnflag, l_linestatus, feature, round(r, 6) AS r, n FROM c")
def feature_response_corr(t):
    return group_correlations(t).withColumn("r", r(F.col("r")))


@query(f"WITH {LONG_SQL} SELECT l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN 'All' ELSE l_linestatus END AS l_linestatus, feature, round(CASE WHEN count(*) >= {MINIMUM} THEN {CORR_VY} END, 6) AS r, count(*) AS n FROM long GROUP BY GROUPING SETS ((l_returnflag, feature, l_linestatus), (l_returnflag, feature))")
def feature_corr_two_level(t):
    return stats.two_level_correlations(long(t), ["l_returnflag"], "l_linestatus", "l_extendedprice", MINIMUM).withColumn("r", r(F.col("r")))


@query(f"""WITH {LONG_SQL}, c AS (
  SELECT l_returnflag, l_linestatus, feature, {CORR_VY} AS xy, {CORR.format(x="value", y="control")} AS xz, {CORR.format(x="l_extendedprice", y="control")} AS yz FROM long GROUP BY ALL)
SELECT l_returnflag, l_linestatus, feature, round(CASE WHEN feature = 'l_tax' THEN xy WHEN (1 - xz * xz) * (1 - yz * yz) > 1e-18 THEN (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) END, 6) AS r FROM c""")
def partial_corr(t):
    df = t("lineitem").withColumn("control", F.col("l_tax"))
    both = reshape.to_long(df, [*GROUP, "l_extendedprice", "control"], FEATURES).withColumn("l_tax", F.col("control"))
    return stats.partial_correlations(both, GROUP, "l_extendedprice", "l_tax").withColumn("r", r(F.col("r")))


@query(f"""WITH k AS (
  SELECT o_orderstatus, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderstatus, o_custkey) - 1) / 2.0 AS b FROM orders)
SELECT o_orderstatus, round({CORR.format(x="a", y="b")}, 6) AS r, count(*) AS n FROM k GROUP BY ALL""")
def spearman_corr(t):
    return stats.spearman(t("orders"), ["o_orderstatus"], "o_totalprice", "o_custkey").withColumn("r", r(F.col("r")))


LEAST, METHODS = 20, ("pearson", "spearman", "kendall")
#: Customers by segment (key) and region (level, and All): two features with holes, the nation as a response with ties.
MIXED_SQL = """mixed AS (
  SELECT c_mktsegment, n_regionkey::VARCHAR AS region, c_custkey AS id, f.feature, CASE f.feature WHEN 'acctbal' THEN c_acctbal WHEN 'key' THEN c_custkey % 50 ELSE c_custkey % 9 END::DOUBLE AS value, CASE WHEN c_custkey % 7 > 0 THEN c_nationkey::DOUBLE END AS y, (c_custkey % 9)::DOUBLE AS z
  FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES ('acctbal'), ('key'), ('z')) f(feature)
), both_ AS (SELECT * FROM mixed UNION ALL SELECT c_mktsegment, 'All', id, feature, value, y, z FROM mixed
), whole AS (SELECT *, count(*) OVER (PARTITION BY c_mktsegment, region, feature) AS n FROM both_ WHERE value IS NOT NULL AND y IS NOT NULL
), g AS (SELECT * FROM whole WHERE n >= 20
), ranks AS (
  SELECT *, rank() OVER (w ORDER BY value) + (count(*) OVER (PARTITION BY c_mktsegment, region, feature, value) - 1) / 2.0 AS rv,
    rank() OVER (w ORDER BY y) + (count(*) OVER (PARTITION BY c_mktsegment, region, feature, y) - 1) / 2.0 AS ry, rank() OVER (w ORDER BY z) + (count(*) OVER (PARTITION BY c_mktsegment, region, feature, z) - 1) / 2.0 AS rz
  FROM g WINDOW w AS (PARTITION BY c_mktsegment, region, feature)
), signs AS (
  SELECT a.c_mktsegment, a.region, a.feature, a.n, sign(a.value - b.value) AS v, sign(a.y - b.y) AS y, sign(a.z - b.z) AS z
  FROM g a JOIN g b ON a.c_mktsegment = b.c_mktsegment AND a.region = b.region AND a.feature = b.feature AND a.id < b.id
)"""


def _tau(a, b):
    return f"CASE WHEN sum({a} * {a}) * sum({b} * {b}) > 0 THEN sum({a} * {b}) / sqrt(sum({a} * {a}) * sum({b} * {b})) END"


def _by_method(columns):
    """SQL of columns (name, left, right) by method over g, ranks and signs."""
    plain, ranked, signed = {"v": "value", "y": "y", "z": "z"}, {"v": "rv", "y": "ry", "z": "rz"}, {"v": "v", "y": "y", "z": "z"}
    parts = []
    for method, source, names, f in (("pearson", "g", plain, CORR), ("spearman", "ranks", ranked, CORR), ("kendall", "signs", signed, None)):
        got = ", ".join((f.format(x=names[a], y=names[b]) if f else _tau(names[a], names[b])) + f" AS {c}" for c, a, b in columns)
        parts.append(f"SELECT '{method}' AS method, c_mktsegment, region, feature, max(n) AS n, {got} FROM {source} GROUP BY ALL")
    return " UNION ALL ".join(parts)


def mixed(t):
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    c = c.select("c_mktsegment", F.col("n_regionkey").cast("string").alias("region"), F.when(k % 7 > 0, F.col("c_nationkey").cast("double")).alias("y"), (k % 9).cast("double").alias("z0"), F.col("c_acctbal").alias("acctbal"), (k % 50).alias("key"), (k % 9).alias("z"))
    return reshape.to_long(c, ["c_mktsegment", "region", "y", "z0"], ["acctbal", "key", "z"]).withColumnRenamed("z0", "z")


@query(f"WITH {MIXED_SQL} SELECT method, c_mktsegment, region, feature, n, round(r, 6) AS r FROM ({_by_method([('r', 'v', 'y')])})")
def corr_methods_two_level(t):
    return stats.method_correlations(mixed(t), ["c_mktsegment"], "region", "y", LEAST, METHODS).withColumn("r", r(F.col("r")))


@query(f"""WITH {MIXED_SQL}, c AS ({_by_method([('xy', 'v', 'y'), ('xz', 'v', 'z'), ('yz', 'y', 'z')])})
SELECT method, c_mktsegment, region, feature, n, round(CASE WHEN feature = 'z' THEN xy WHEN (1 - xz * xz) * (1 - yz * yz) > 1e-18 THEN (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) END, 6) AS r FROM c""")
def partial_methods_two_level(t):
    return stats.method_partial_correlations(mixed(t), ["c_mktsegment"], "region", "y", "z", LEAST, METHODS).withColumn("r", r(F.col("r")))


@query(CORR_SQL + ", m AS (SELECT feature, median(r) AS middle, avg(r) AS mean, stddev_samp(r) AS sd, bool_or(abs(r) > 0.1) AS strong FROM c GROUP BY feature) SELECT feature, round(middle, 6) AS middle, round(mean, 6) AS mean, round(sd, 6) AS sd, strong FROM m ORDER BY abs(middle) DESC, feature LIMIT 2")
def topn_features_abs_median(t):
    m = group_correlations(t).groupBy("feature").agg(F.median("r").alias("middle"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.bool_or(F.abs("r") > 0.1).alias("strong"))
    top = rel.top_by(m, [], [F.abs("middle").desc_nulls_last(), F.col("feature")], 2)
    return top.withColumns({c: r(F.col(c)) for c in ("middle", "mean", "sd")})


@query(CORR_SQL + ", d AS (SELECT l_returnflag, feature, max(CASE WHEN l_linestatus = 'O' THEN r END) - max(CASE WHEN l_linestatus = 'F' THEN r END) AS diff FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(diff) DESC NULLS LAST, feature) AS i FROM d) SELECT l_returnflag, feature, round(diff, 6) AS diff FROM k WHERE i <= 2")
def low_high_difference_top(t):
    wide = reshape.to_wide(group_correlations(t), ["l_returnflag", "feature"], "l_linestatus", "r", ["O", "F"])
    d = wide.select("l_returnflag", "feature", (F.col("O") - F.col("F")).alias("diff"))
    return rel.top_by(d, ["l_returnflag"], [F.abs("diff").desc_nulls_last(), F.col("feature")], 2).withColumn("diff", r(F.col("diff")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1e6 * l_quantity / sum(l_quantity) OVER (PARTITION BY l_suppkey), 6) AS per_million FROM lineitem")
def share_per_million(t):
    l = with_totals(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_suppkey"], total=F.sum("l_quantity"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(F.try_divide(F.lit(1e6) * F.col("l_quantity"), F.col("total"))).alias("per_million"))


@query("SELECT p_brand, round(sum(l_quantity), 4) AS quantity, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand")
def gene_style_sum(t):
    return t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand").agg(F.round(F.sum("l_quantity"), 4).alias("quantity"), F.count("*").alias("n"))


MONTHS_SQL = "m AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS total FROM orders GROUP BY ALL), n AS (SELECT count(DISTINCT month) AS months FROM m), d AS (SELECT o_custkey, CASE WHEN count(*) > 0 THEN sqrt(var_pop(total) * count(total) / (any_value(months) - 1)) END AS sd, count(*) AS n FROM m, n GROUP BY o_custkey)"


def dispersions(t):
    m = t("orders").groupBy("o_custkey", F.date_trunc("month", "o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("total"))
    months = m.select("month").distinct().agg(F.count("*").alias("months"))
    return m.crossJoin(F.broadcast(months)).groupBy("o_custkey").agg(padded_dispersion(F.col("total"), F.first("months")).alias("sd"), F.count("*").alias("n"))  # one row broadcast


@query(f"WITH {MONTHS_SQL} SELECT o_custkey, round(sd, 3) AS sd, n FROM d")
def adjusted_dispersion(t):
    return dispersions(t).withColumn("sd", r(F.col("sd"), 3))


@query(f"WITH {MONTHS_SQL}, k AS (SELECT d.*, c_mktsegment, median(sd) OVER (PARTITION BY c_mktsegment) AS middle FROM d JOIN customer ON c_custkey = o_custkey) SELECT o_custkey, c_mktsegment, CASE WHEN sd < middle THEN 'Low' ELSE 'High' END AS variability FROM k")
def variability_class(t):
    d = dispersions(t).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    d = with_totals(d.select("o_custkey", "c_mktsegment", "sd"), ["c_mktsegment"], middle=F.median("sd"))
    return d.select("o_custkey", "c_mktsegment", F.when(F.col("sd") < F.col("middle"), "Low").otherwise("High").alias("variability"))


@query("SELECT event_type, user_id, round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT *, CASE WHEN event_id % 10 = 0 THEN -1 ELSE value END AS v FROM events) WHERE v <> -1 GROUP BY ALL")
def sentinel_mean(t):
    v = t("events").withColumn("v", F.when(F.col("event_id") % 10 == 0, F.lit(-1.0)).otherwise(F.col("value")))
    return v.filter("v <> -1").groupBy("event_type", "user_id").agg(r(F.avg("v")).alias("mean"), F.count("*").alias("n"))


@query("SELECT l_orderkey, min(l_partkey) AS first, max(l_partkey) AS last, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS parts FROM lineitem GROUP BY l_orderkey")
def list_min_max_per_key(t):
    parts = F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string"))
    return t("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("first"), F.max("l_partkey").alias("last"), F.array_join(parts, ",").alias("parts"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 3 AND bool_and(o_orderpriority <> '')")
def complete_set_entities(t):
    g = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderstatus").alias("k"), F.bool_and(F.col("o_orderpriority") != "").alias("whole"))
    return g.filter("k = 3 AND whole").select("o_custkey", "n")


@query("WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS c FROM events GROUP BY ALL) SELECT user_id, round(avg(c), 6) AS mean, round(stddev_samp(c) / sqrt(count(*)), 6) AS se, count(*) AS n FROM d GROUP BY user_id")
def replicate_mean_se(t):
    d = t("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("c"))
    return d.groupBy("user_id").agg(r(F.avg("c")).alias("mean"), r(F.stddev_samp("c") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def running_total(t):
    keys, order = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    rows = ranged(t("orders").select(*keys, *order, "o_totalprice"), keys, order)
    return running(rows, keys, order, "running", F.col("o_totalprice")).select("o_orderkey", "o_custkey", F.round("running", 2).alias("running"))


P_SQL = "p AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE ((o_orderkey * 7919) % 10007 + 1) / 10008.0 END AS p FROM orders)"
FDR_SQL = f"""{P_SQL}, q AS (
  SELECT *, p * count(*) OVER (PARTITION BY o_orderstatus) / row_number() OVER (PARTITION BY o_orderstatus ORDER BY p, o_orderkey) AS q FROM p WHERE p IS NOT NULL
), a AS (
  SELECT o_orderkey, o_orderstatus, p, least(1.0, min(q) OVER (PARTITION BY o_orderstatus ORDER BY p DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING)) AS adjusted FROM q
  UNION ALL SELECT o_orderkey, o_orderstatus, p, NULL FROM p WHERE p IS NULL)"""


def adjusted(t):
    k = F.col("o_orderkey")
    p = t("orders").select("o_orderkey", "o_orderstatus", F.when(k % 11 != 0, ((k * 7919) % 10007 + 1) / 10008.0).alias("p"))
    return stats.adjusted_p(p, ["o_orderstatus"], "p", ["o_orderkey"])


@query(f"WITH {FDR_SQL} SELECT o_orderkey, o_orderstatus, round(adjusted, 9) AS adjusted FROM a")
def fdr_adjust(t):
    return adjusted(t).select("o_orderkey", "o_orderstatus", r(F.col("adjusted"), 9).alias("adjusted"))


@query(f"WITH {FDR_SQL} SELECT o_orderkey, CASE WHEN adjusted IS NULL THEN 'not tested' WHEN adjusted > 0.9 THEN 'no signal' WHEN p IS NULL THEN 'signal, second not tested' WHEN p <= 0.9 THEN 'signal and more' ELSE 'signal' END AS call FROM a")
def label_calls(t):
    return stats.label_calls(adjusted(t), "adjusted", "p", 0.9).select("o_orderkey", "call")


@query(f"WITH {FDR_SQL}, h AS (SELECT DISTINCT o_orderkey % 1000 AS hit FROM a WHERE adjusted <= 0.9) SELECT o_orderkey, o_orderkey IN (SELECT hit FROM h) AS rotation_hit FROM orders")
def rotation_hit(t):
    hit = adjusted(t).filter("adjusted <= 0.9").select((F.col("o_orderkey") % 1000).alias("hit")).distinct()
    o = t("orders").select("o_orderkey")
    return o.join(hit, F.col("o_orderkey") == F.col("hit"), "left").select("o_orderkey", F.col("hit").isNotNull().alias("rotation_hit"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def crosstab_counts(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, round_even(100.0::DOUBLE * sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) / count(*), 1) AS percent FROM lineitem GROUP BY l_suppkey")
def percent_rounding(t):
    share = F.lit(100.0) * F.sum(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)) / F.count("*")
    return t("lineitem").groupBy("l_suppkey").agg(round_even(share, 1).alias("percent"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'l_quantity' AS feature, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax FROM lineitem WHERE l_tax IS NOT NULL")
def wide_to_long(t):
    return reshape.to_long(t("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_tax"], drop_missing=True)


@query("SELECT l_suppkey, max(CASE WHEN l_returnflag = 'A' THEN q END) AS \"qty;A\", max(CASE WHEN l_returnflag = 'N' THEN q END) AS \"qty;N\", max(CASE WHEN l_returnflag = 'R' THEN q END) AS \"qty;R\" FROM (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def long_to_wide(t):
    s = t("lineitem").groupBy("l_suppkey", F.concat(F.lit("qty;"), "l_returnflag").alias("name")).agg(F.sum("l_quantity").alias("q"))
    return reshape.to_wide(s, ["l_suppkey"], "name", "q", ["qty;A", "qty;N", "qty;R"])


@query("SELECT l_orderkey, coalesce(sum(l_quantity) FILTER (l_linenumber = 1), 0) AS \"1\", coalesce(sum(l_quantity) FILTER (l_linenumber = 2), 0) AS \"2\", coalesce(sum(l_quantity) FILTER (l_linenumber = 3), 0) AS \"3\" FROM lineitem GROUP BY l_orderkey")
def pivot_fill0(t):
    s = t("lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("string").alias("name")).agg(F.sum("l_quantity").alias("q"))
    return reshape.to_wide(s, ["l_orderkey"], "name", "q", ["1", "2", "3"], fill=0.0)


@query(f"WITH {LONG_SQL} SELECT l_suppkey, feature FROM long WHERE NOT (l_suppkey % 5 = 0 AND feature = 'l_tax') GROUP BY ALL HAVING count(value) > 0 AND stddev_samp(value) > 0")
def constant_column_prune(t):
    x = long(t).withColumn("value", F.when(~((F.col("l_suppkey") % 5 == 0) & (F.col("feature") == "l_tax")), F.col("value")))
    return reshape.usable_features(x, keys=("l_suppkey",))


@query(f"WITH {LONG_SQL} SELECT CASE WHEN starts_with(feature, 'l_q') THEN 'amount' ELSE 'rate' END AS family, feature, feature NOT IN (SELECT 'l_tax') AS near, count(*) AS n FROM long GROUP BY ALL")
def feature_family_split(t):
    x = reshape.families(long(t), {"l_q": "amount"}, "rate")
    return x.groupBy("family", "feature", (F.col("feature") != "l_tax").alias("near")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(list_avg([l_quantity, l_discount, l_tax]), 6) AS mean, round(list_stddev_samp([l_quantity, l_discount, l_tax]), 6) AS sd, list_min([l_quantity, l_discount, l_tax]) AS least FROM lineitem")
def rowwise_stats(t):
    a = F.array(*FEATURES)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / 3
    sd = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / 2)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(mean).alias("mean"), r(sd).alias("sd"), F.array_min(a).alias("least"))


@query(f"SELECT l_suppkey, round({CORR.format(x='l_quantity', y='l_extendedprice')}, 6) AS r FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 20 AND stddev_samp(l_quantity) > 1 AND count(DISTINCT l_returnflag) >= 2 AND bool_or(l_discount > 0.09)")
def group_size_spread_gate(t):
    having = (F.count("*") >= 20) & (F.stddev_samp("l_quantity") > 1) & (F.size(F.collect_set("l_returnflag")) >= 2) & F.bool_or(F.col("l_discount") > 0.09)
    kept = rel.groups_where(t("lineitem"), ["l_suppkey"], having)
    return kept.groupBy("l_suppkey").agg(r(safe_corr(F.col("l_quantity"), F.col("l_extendedprice"))).alias("r"))


@query("WITH d AS (SELECT DISTINCT l_suppkey, l_quantity FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS i FROM d) SELECT l_suppkey, l_quantity FROM k WHERE i <= 3")
def first_n_distinct(t):
    return rel.distinct_first(t("lineitem"), ["l_suppkey"], ["l_quantity"], [F.col("l_quantity").desc()], 3)


@query("WITH s AS (SELECT l_suppkey, l_returnflag, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS m, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY ALL) SELECT a.l_suppkey, a.m = b.m AS same, a.n AS n_a, b.n AS n_r FROM s a JOIN s b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R'")
def set_compare_arms(t):
    arm = lambda f: F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == f, F.col("l_linenumber"))))
    g = t("lineitem").filter("l_quantity > 40").groupBy("l_suppkey").agg(arm("A").alias("a"), arm("R").alias("b"))
    return g.filter((F.size("a") > 0) & (F.size("b") > 0)).select("l_suppkey", (F.col("a") == F.col("b")).alias("same"), F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_r"))
