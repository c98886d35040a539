"""Curves, per-fold summaries, closed-form fits, saved models and the frames that figures are drawn from."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratawell.operators import evaluation as evl, modelling as md, relational as rel
from stratawell.operators.ordered import with_totals
from stratawell.plans import assemble, model_queries as mq
from stratawell.plans.registry import query, r
from stratawell.session import scratch
from stratawell.sources import readers, writers

SCORED_SQL = mq.SCORED_SQL
POINTS_SQL = f"""{SCORED_SQL}, g AS (SELECT lang, score, count(*) AS n, sum(truth) AS p FROM x GROUP BY ALL),
k AS (SELECT lang, score, p, sum(p) OVER w AS tp, sum(n) OVER w AS called, sum(p) OVER (PARTITION BY lang)::DOUBLE AS cases, sum(n) OVER (PARTITION BY lang)::DOUBLE AS everything FROM g WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {POINTS_SQL} SELECT lang, round(score, 6) AS threshold, round(tp / nullif(cases, 0), 6) AS tpr, round((called - tp) / nullif(everything - cases, 0), 6) AS fpr FROM k")
def roc_points(t):
    p = evl.roc_points(mq.scored(t), ["lang"], "truth", "score")
    return p.select("lang", *[r(F.col(c)).alias(c) for c in ("threshold", "tpr", "fpr")])


@query(f"WITH {POINTS_SQL} SELECT lang, round(sum(p / nullif(cases, 0) * tp / called), 6) AS pr_area FROM k GROUP BY lang")
def pr_area(t):
    return evl.pr_area(mq.scored(t), ["lang"], "truth", "score").select("lang", r(F.col("pr_area")).alias("pr_area"))


@query(f"""WITH {SCORED_SQL}, f AS (SELECT *, doc_id % 3 + 1 AS fold, greatest(least(score, 1 - 1e-15), 1e-15) AS s FROM x),
c AS (SELECT fold, count(*) FILTER (truth = 1 AND predicted = 1)::DOUBLE AS tp, count(*) FILTER (truth = 0 AND predicted = 1)::DOUBLE AS fp, count(*) FILTER (truth = 1 AND predicted = 0)::DOUBLE AS fn, count(*) FILTER (truth = 0 AND predicted = 0)::DOUBLE AS tn, avg(-ln(CASE WHEN truth = 1 THEN s ELSE 1 - s END)) AS log_loss FROM f GROUP BY fold),
g AS (SELECT fold, score, count(*) AS n, sum(truth) AS p FROM f GROUP BY ALL),
k AS (SELECT fold, n, p, sum(p) OVER w AS tp, sum(n) OVER w AS called, sum(p) OVER (PARTITION BY fold)::DOUBLE AS p1, sum(n) OVER (PARTITION BY fold)::DOUBLE AS nn FROM g WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
a AS (SELECT fold, sum(p / nullif(p1, 0) * tp / called) AS pr_area, sum((n - p) * (tp - p / 2.0)) / nullif(any_value(p1) * (any_value(nn) - any_value(p1)), 0) AS auroc FROM k GROUP BY fold)
SELECT fold, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(log_loss, 5) AS log_loss, round(auroc, 6) AS auroc, round(pr_area, 6) AS pr_area FROM c JOIN a USING (fold)""")
def fold_metrics(t):
    x = mq.scored(t).withColumn("fold", F.col("doc_id") % 3 + 1)
    m = evl.by_fold(x, [], "fold", "truth", "predicted", "score")
    return m.select("fold", *[r(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "auroc", "pr_area")], r(F.col("log_loss"), 5).alias("log_loss"))


@query("WITH s AS (SELECT c_nationkey, avg(c_acctbal) FILTER (c_custkey % 5 > 0) AS m, stddev_samp(c_acctbal) FILTER (c_custkey % 5 > 0) AS sd FROM customer GROUP BY c_nationkey) SELECT c_custkey, round((c_acctbal - m) / nullif(sd, 0), 6) AS scaled FROM customer JOIN s USING (c_nationkey)")
def response_scaled(t):
    s = md.response_scaled(t("customer"), "c_acctbal", F.col("c_custkey") % 5 > 0, ["c_nationkey"])
    return s.select("c_custkey", r(F.col("scaled_response")).alias("scaled"))


@query("WITH g AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL), s AS (SELECT c_nationkey, sum(n) OVER (ORDER BY c_nationkey) - n AS before, sum(n) OVER () AS everything FROM g) SELECT c_nationkey FROM s WHERE before < 0.1 * everything")
def share_holdout(t):
    return md.share_holdout(t("customer"), "c_nationkey", 0.1, None)


@query("SELECT o_orderkey, o_orderstatus, coalesce(list_position(['P', 'O'], o_orderstatus), 3) AS place FROM orders")
def category_order(t):
    return rel.with_place(t("orders"), "o_orderstatus", ["P", "O"]).select("o_orderkey", "o_orderstatus", "place")


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE (o_custkey, o_orderdate) IN (SELECT (o_custkey, o_orderdate) FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) = 1)")
def single_occurrence(t):
    return rel.occurs_once(t("orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey", "o_orderdate"])


@query("SELECT count(*) AS n_shared, count(*) = 0 AS disjoint FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def disjoint_sets(t):
    o = t("orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return rel.disjoint(t("customer"), o, ["c_custkey"])


@query("SELECT e AS event_type, f AS row_filter, s AS feature_set FROM (VALUES ('SE'), ('RI')) a(e), (VALUES ('all'), ('Low'), ('High')) b(f), (VALUES ('all'), ('non_epigenetic'), ('epigenetic')) c(s)")
def model_grid(t):
    rows = assemble.configurations(("SE", "RI"))
    return t("region").sparkSession.createDataFrame(rows, "event_type string, row_filter string, feature_set string")


# ----- fits with a closed form: one feature -----

ONE_SQL = "d AS (SELECT d.doc_id, quality, CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END AS long FROM documents d JOIN labels l ON l.doc_id = d.doc_id), s AS (SELECT avg(quality) FILTER (long = 0) AS p0, avg(quality) FILTER (long = 1) AS p1 FROM d)"


def long_documents(t):
    d = t("documents").join(t("labels"), "doc_id")
    return d.select("doc_id", F.col("quality").cast("double").alias("quality"), F.when(F.col("n_chars") > 1000, 1.0).otherwise(0.0).alias("long"))


def coefficients(df, model):
    return df.sparkSession.createDataFrame([(round(float(model.intercept), 3), round(float(model.coefficients[0]), 3))], "intercept double, slope double")


@query(f"WITH {ONE_SQL} SELECT round(ln(p0 / (1 - p0)), 3) AS intercept, round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 3) AS slope FROM s")
def logistic_free(t):
    df = long_documents(t)
    return coefficients(df, md.logistic_l1(df, ["long"], "quality", None, 0.0).stages[-1])


@query("WITH x AS (SELECT l_discount * 10 AS y, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS flag FROM lineitem), s AS (SELECT avg(y) FILTER (flag = 0) AS p0, avg(y) FILTER (flag = 1) AS p1 FROM x) SELECT round(ln(p0 / (1 - p0)), 3) AS intercept, round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 3) AS slope FROM s")
def fractional_logit(t):
    x = t("lineitem").select((F.col("l_discount") * 10).alias("y"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("flag"))
    return coefficients(x, md.fractional_logit(x, ["flag"], "y").stages[-1])


STRENGTH = 1000.0


@query(f"""WITH s AS (SELECT l_suppkey, count(*) AS n, covar_pop(l_quantity, l_extendedprice) AS cov, stddev_pop(l_quantity) AS sd, stddev_pop(l_extendedprice) AS sy FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey::VARCHAR AS unit, round(CASE WHEN sd > 0 THEN sign(cov) * greatest(abs(cov / sd) - {STRENGTH}, 0) / sd ELSE 0 END, 3) + 0.0 AS coefficient FROM s WHERE n >= 10 AND sy > 0""")
def lasso_one_feature(t):
    l = t("lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("key"))
    f = md.unit_fits(l, "l_suppkey", ["l_quantity"], "l_extendedprice", None, "key", [STRENGTH], 5, 1234)
    return f.filter("arm = 'real' AND status = 'ok'").select("unit", (r(F.col("coefficient"), 3) + 0.0).alias("coefficient"))


@query(None)
def selected_by_fold(t):
    return md.fold_features(mq.fits(t))


@query(f"WITH {ONE_SQL} SELECT doc_id, TRUE AS same FROM d")
def model_saved(t):
    df = long_documents(t)
    fitted = md.logistic_l1(df, ["long"], "quality", None, 0.0)
    path = scratch(df.sparkSession, "model")
    writers.model(fitted, path)
    a, b = fitted.transform(df).select("doc_id", "probability"), readers.model(path).transform(df).select("doc_id", F.col("probability").alias("again"))
    return a.join(b, "doc_id").select("doc_id", (F.col("probability") == F.col("again")).alias("same"))


# ----- frames that figures are drawn from -----


@query("""WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS lower, median(o_totalprice) AS middle, quantile_cont(o_totalprice, 0.75) AS upper, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_orderpriority, n, round(lower, 4) AS lower, round(middle, 4) AS middle, round(upper, 4) AS upper, min(o_totalprice) FILTER (o_totalprice >= lower - 1.5 * (upper - lower)) AS whisker_low, max(o_totalprice) FILTER (o_totalprice <= upper + 1.5 * (upper - lower)) AS whisker_high FROM orders JOIN q USING (o_orderpriority) GROUP BY ALL""")
def box_frame(t):
    """What a box plot shows: quartiles and the last values within 1.5 times their range."""
    o, k = t("orders").select("o_orderpriority", "o_totalprice"), "o_orderpriority"
    v, at = F.col("o_totalprice"), lambda p: F.percentile("o_totalprice", F.lit(p))
    q = o.groupBy(k).agg(F.count("*").alias("n"), at(0.25).alias("lower"), at(0.5).alias("middle"), at(0.75).alias("upper"))
    reach = 1.5 * (F.col("upper") - F.col("lower"))
    x = o.join(q, k).groupBy(k, "n", "lower", "middle", "upper")
    x = x.agg(F.min(F.when(v >= F.col("lower") - reach, v)).alias("whisker_low"), F.max(F.when(v <= F.col("upper") + reach, v)).alias("whisker_high"))
    return x.select(k, "n", *[r(F.col(c), 4).alias(c) for c in ("lower", "middle", "upper")], "whisker_low", "whisker_high")


@query("WITH m AS (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '&' ORDER BY o_orderstatus) AS sets FROM orders GROUP BY o_custkey) SELECT sets, count(*) AS n FROM m GROUP BY sets")
def upset_frame(t):
    """How many members each combination of sets has."""
    m = t("orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), "&").alias("sets"))
    return m.groupBy("sets").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY l_returnflag)), 6) AS share FROM lineitem GROUP BY l_returnflag, l_linestatus")
def tile_frame(t):
    """Counts and row shares of the tiles of two categories."""
    n = t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return with_totals(n, ["l_returnflag"], __all=F.sum("n")).select("l_returnflag", "l_linestatus", "n", r(F.col("n") / F.col("__all")).alias("share"))
