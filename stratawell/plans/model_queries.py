"""Splits, preprocessing, fits and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from stratawell.operators import evaluation as evl, modelling as md, relational as rel, reshape, stats
from stratawell.plans import global_models as gm
from stratawell.plans.registry import query, r
from stratawell.plans.statistics_queries import FEATURES, LONG_SQL


@query("SELECT c_custkey, c_mktsegment = 'BUILDING' AS in_segment, n_regionkey IN (1, 2) AS in_region, c_mktsegment = 'BUILDING' OR n_regionkey IN (1, 2) AS test, c_mktsegment = 'BUILDING' AND n_regionkey IN (1, 2) AS strict_test FROM customer JOIN nation ON c_nationkey = n_nationkey")
def holdout_split(t):
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    h = md.holdout(c, {"c_mktsegment": ["BUILDING"], "n_regionkey": [1, 2]})
    return h.select("c_custkey", F.col("in_c_mktsegment").alias("in_segment"), F.col("in_n_regionkey").alias("in_region"), "test", "strict_test")


@query("SELECT n_name, round(avg(CAST(c_mktsegment = 'BUILDING' AS INTEGER)), 6) AS share, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def holdout_shares(t):
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_name").agg(r(F.avg((F.col("c_mktsegment") == "BUILDING").cast("double"))).alias("share"), F.count("*").alias("n"))


@query("WITH g AS (SELECT o_custkey, o_orderstatus, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY ALL) SELECT o_custkey, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END)::BIGINT AS varying, count(*) AS groups FROM g GROUP BY o_custkey")
def varying_groups(t):
    g = t("orders").groupBy("o_custkey", "o_orderstatus").agg(F.countDistinct("o_orderpriority").alias("k"))
    return g.groupBy("o_custkey").agg(F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).alias("varying"), F.count("*").alias("groups"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice / 500000 <= 1.0 / 3 THEN 'control' ELSE 'case' END AS class FROM orders WHERE o_totalprice / 500000 <= 1.0 / 3 OR o_totalprice / 500000 >= 2.0 / 3")
def dichotomise_thirds(t):
    o = t("orders").withColumn("x", F.col("o_totalprice") / 500000)
    return md.dichotomised(o, "x", 1 / 3, 2 / 3, ("control", "case")).select("o_orderkey", "class")


HOLES_SQL = f"{LONG_SQL}, h AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_extendedprice, feature, CASE WHEN l_orderkey % 7 <> 0 THEN value END AS value, l_returnflag <> 'R' AS train FROM long), m AS (SELECT feature, avg(value) FILTER (train) AS mean FROM h GROUP BY feature), i AS (SELECT h.*, coalesce(value, mean) AS imputed, mean FROM h JOIN m USING (feature)), s AS (SELECT feature, stddev_samp(imputed) FILTER (train) AS sd FROM i GROUP BY feature)"


def with_holes(t):
    l = t("lineitem").withColumns({c: F.when(F.col("l_orderkey") % 7 != 0, F.col(c)) for c in FEATURES})
    x = reshape.to_long(l, ["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_extendedprice"], FEATURES)
    return md.imputed_scaled(x, F.col("l_returnflag") != "R")


@query(f"WITH {HOLES_SQL} SELECT l_orderkey, l_linenumber, l_suppkey, feature, round(imputed, 6) AS imputed FROM i")
def impute_mean_train(t):
    return with_holes(t).select("l_orderkey", "l_linenumber", "l_suppkey", "feature", r(F.col("imputed")).alias("imputed"))


@query(f"WITH {HOLES_SQL} SELECT l_orderkey, l_linenumber, l_suppkey, i.feature, round((imputed - mean) / sd, 6) AS scaled FROM i JOIN s ON s.feature = i.feature")
def zscore_train(t):
    return with_holes(t).select("l_orderkey", "l_linenumber", "l_suppkey", "feature", r(F.col("scaled")).alias("scaled"))


@query("WITH g AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL), p AS (SELECT c_nationkey, n, row_number() OVER (ORDER BY n DESC, c_nationkey) - 1 AS place FROM g) SELECT c_nationkey, n, (CASE WHEN (place // 5) % 2 = 0 THEN place % 5 + 1 ELSE 5 - place % 5 END)::INTEGER AS fold FROM p")
def group_folds(t):
    c = t("customer")
    return c.groupBy("c_nationkey").agg(F.count("*").alias("n")).join(md.group_folds(c, "c_nationkey", 5, None), "c_nationkey")


@query(None)
def group_folds_balanced(t):
    c = t("customer")
    return c.join(md.group_folds(c, "c_nationkey", 5, 1234), "c_nationkey").groupBy("fold").agg(F.count("*").alias("size"), F.countDistinct("c_nationkey").alias("groups"))


@query("SELECT doc_id, toxic, round(count(*) OVER () * 1.0 / count(*) OVER (PARTITION BY toxic), 6) AS weight FROM labels")
def class_weights(t):
    return md.class_weights(t("labels"), "toxic").select("doc_id", "toxic", r(F.col("weight")).alias("weight"))


SCORED_SQL = "x AS (SELECT d.doc_id, lang, quality AS truth, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS predicted, (n_chars % 100) / 100.0 AS score FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def scored(t):
    d = t("documents").join(t("labels"), "doc_id")
    return d.select("doc_id", "lang", F.col("quality").alias("truth"), F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("predicted"), ((F.col("n_chars") % 100) / 100.0).alias("score"))


CONFUSION_SQL = f"""WITH {SCORED_SQL}, c AS (SELECT lang, count(*) FILTER (truth = 1 AND predicted = 1) AS tp, count(*) FILTER (truth = 0 AND predicted = 1) AS fp, count(*) FILTER (truth = 1 AND predicted = 0) AS fn, count(*) FILTER (truth = 0 AND predicted = 0) AS tn FROM x GROUP BY lang),
d AS (SELECT *, (tp + fp + fn + tn)::DOUBLE AS n, tp / nullif((tp + fn)::DOUBLE, 0) AS recall, tn / nullif((tn + fp)::DOUBLE, 0) AS spec FROM c), e AS (SELECT *, (tp + tn) / n AS accuracy, ((tp + fp)::DOUBLE * (tp + fn) + (fn + tn)::DOUBLE * (fp + tn)) / (n * n) AS chance FROM d)"""


@query(CONFUSION_SQL + " SELECT lang, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round((recall + spec) / 2, 6) AS balanced_accuracy, round(tp / nullif((tp + fp)::DOUBLE, 0), 6) AS precision, round(recall, 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM e")
def confusion_metrics(t):
    c = evl.confusion(scored(t), ["lang"], "truth", "predicted")
    return c.select("lang", "tp", "fp", "fn", "tn", *[r(F.col(x)).alias(x) for x in ("accuracy", "balanced_accuracy", "precision", "recall", "f1")])


@query(CONFUSION_SQL + " SELECT lang, round((accuracy - chance) / nullif(1 - chance, 0), 6) AS kappa, round((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc FROM e")
def mcc_kappa(t):
    return evl.confusion(scored(t), ["lang"], "truth", "predicted").select("lang", r(F.col("kappa")).alias("kappa"), r(F.col("mcc")).alias("mcc"))


@query(f"WITH {SCORED_SQL}, k AS (SELECT lang, truth, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS a FROM x), s AS (SELECT lang, sum(CASE WHEN truth = 1 THEN a END) AS u, sum(truth)::DOUBLE AS n1, count(*) - sum(truth)::DOUBLE AS n0 FROM k GROUP BY lang) SELECT lang, round((u - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0), 6) AS auroc, n1, n0 FROM s")
def auroc_rank(t):
    return evl.auroc(scored(t), ["lang"], "truth", "score").withColumn("auroc", r(F.col("auroc")))


@query(f"WITH {SCORED_SQL}, g AS (SELECT lang, score, count(*) AS n, sum(truth) AS p FROM x GROUP BY ALL), k AS (SELECT lang, score AS threshold, sum(p) OVER w AS tp, sum(n) OVER w AS called, sum(p) OVER (PARTITION BY lang) AS everything FROM g WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT lang, round(threshold, 6) AS threshold, tp::BIGINT AS tp, called::BIGINT AS called, round(tp / nullif(everything, 0)::DOUBLE, 6) AS recall, round(tp / called::DOUBLE, 6) AS precision FROM k")
def pr_points(t):
    p = evl.pr_points(scored(t), ["lang"], "truth", "score")
    return p.select("lang", *[r(F.col(c)).alias(c) for c in ("threshold",)], "tp", "called", r(F.col("recall")).alias("recall"), r(F.col("precision")).alias("precision"))


PRED_SQL = "x AS (SELECT l_returnflag, l_orderkey % 5 + 1 AS fold, l_extendedprice AS truth, 1500 * l_quantity AS pred FROM lineitem)"
METRIC_SQL = "count(*) AS n, round(covar_samp(truth, pred) / (stddev_samp(truth) * stddev_samp(pred)), 6) AS r, round(1 - sum((truth - pred) * (truth - pred)) / (var_pop(truth) * count(*)), 6) AS r2, round(sqrt(avg((truth - pred) * (truth - pred))), 3) AS rmse, round(avg(abs(truth - pred)), 3) AS mae"


@query(f"WITH {PRED_SQL} SELECT l_returnflag, CASE WHEN grouping(fold) = 1 THEN 0 ELSE fold END AS fold, {METRIC_SQL} FROM x GROUP BY GROUPING SETS ((l_returnflag, fold), (l_returnflag))")
def regression_metrics_two_level(t):
    x = t("lineitem").select("l_returnflag", (F.col("l_orderkey") % 5 + 1).alias("fold"), F.col("l_extendedprice").alias("truth"), (1500 * F.col("l_quantity")).alias("pred"))
    m = evl.two_level_regression(x, ["l_returnflag"], "fold", "truth", "pred")
    return m.select("l_returnflag", "fold", "n", r(F.col("r")).alias("r"), r(F.col("r2")).alias("r2"), r(F.col("rmse"), 3).alias("rmse"), r(F.col("mae"), 3).alias("mae"))


OLS_SQL = "f AS (SELECT l_suppkey, count(*) AS n, covar_pop(l_quantity, l_extendedprice) / nullif(var_pop(l_quantity), 0) AS slope, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, count(*) * (var_pop(l_extendedprice) - covar_pop(l_quantity, l_extendedprice) ^ 2 / nullif(var_pop(l_quantity), 0)) AS sse, count(*) * var_pop(l_extendedprice) AS sst FROM lineitem GROUP BY l_suppkey)"


def ols(t):
    return stats.simple_regression(t("lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")


@query(f"WITH {OLS_SQL} SELECT l_suppkey, n, round(slope, 4) AS slope, round(my - slope * mx, 3) AS intercept FROM f")
def ols_single(t):
    return ols(t).select("l_suppkey", "n", r(F.col("slope"), 4).alias("slope"), r(F.col("intercept"), 3).alias("intercept"))


@query(f"WITH {OLS_SQL} SELECT l_suppkey, round(CASE WHEN n > 2 THEN (sst - sse) / nullif(sse / (n - 2), 0) END, 4) AS f, n - 2 AS df2 FROM f")
def nested_f_statistic(t):
    return stats.nested_f(ols(t)).select("l_suppkey", r(F.col("f"), 4).alias("f"), F.col("df2").cast("long").alias("df2"))


@query(None)
def nested_f_pvalue(t):
    f = stats.nested_f(ols(t))
    return f.select("l_suppkey", "f", stats.f_p_value("f", "df1", "df2").alias("p"))


@query(f"WITH {OLS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, round(my - slope * mx + slope * l_quantity, 3) AS predicted FROM lineitem JOIN f USING (l_suppkey)")
def ols_predictions(t):
    return t("lineitem").join(ols(t), "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", r(F.col("intercept") + F.col("slope") * F.col("l_quantity"), 3).alias("predicted"))


@query(f"WITH {OLS_SQL} SELECT l_suppkey, 'l_quantity' AS feature, round(slope, 4) AS estimate, CASE WHEN slope > 0 THEN 'positive' ELSE 'negative' END AS sign FROM f")
def coefficient_table(t):
    return ols(t).select("l_suppkey", F.lit("l_quantity").alias("feature"), r(F.col("slope"), 4).alias("estimate"), F.when(F.col("slope") > 0, "positive").otherwise("negative").alias("sign"))


GRID_SQL = "g AS (SELECT l_suppkey, l_linenumber / 100.0 AS strength, avg(l_quantity) / 50 AS metric, stddev_samp(l_quantity) / 50 AS sd FROM lineitem GROUP BY l_suppkey, l_linenumber)"


@query(f"WITH {GRID_SQL}, b AS (SELECT l_suppkey, metric - sd / sqrt(10) AS least FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY metric DESC, strength DESC) AS i FROM g) WHERE i = 1) SELECT l_suppkey, max(strength)::DOUBLE AS strength FROM g JOIN b USING (l_suppkey) WHERE metric >= least GROUP BY l_suppkey")
def one_se_rule(t):
    g = t("lineitem").groupBy("l_suppkey", (F.col("l_linenumber") / 100.0).alias("strength")).agg((F.avg("l_quantity") / 50).alias("metric"), (F.stddev_samp("l_quantity") / 50).alias("sd"))
    return md.one_se(g, ["l_suppkey"], "strength", "metric", "sd", 10)


@query("SELECT toxic, count(*) AS n, round(greatest(avg(quality), 1 - avg(quality)), 6) AS accuracy_base, 0.5 AS auroc_base, round(avg(quality), 6) AS pr_base, 0.0 AS mcc_base FROM labels GROUP BY toxic")
def metric_baselines(t):
    sizes = t("labels").groupBy("toxic").agg(F.count("*").alias("n_test"), F.sum("quality").alias("npos_test"))
    b = gm.baselines(sizes, ("toxic", "n_test"))
    return b.select("toxic", F.col("n_test").alias("n"), r(F.col("accuracy")).alias("accuracy_base"), F.col("auroc").alias("auroc_base"), r(F.col("pr_area")).alias("pr_base"), F.col("mcc").alias("mcc_base"))


@query("SELECT lang, count(*) FILTER (l.doc_id % 4 <> 0) AS n_train, count(*) FILTER (l.doc_id % 4 = 0) AS n_test, count(*) FILTER (l.doc_id % 4 <> 0 AND quality = 1) AS npos_train, count(*) FILTER (l.doc_id % 4 = 0 AND quality = 1) AS npos_test FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY lang")
def sample_sizes(t):
    train, pos = F.col("doc_id") % 4 != 0, F.col("quality") == 1
    n = lambda c: F.count(F.when(c, 1))
    return t("labels").join(t("documents"), "doc_id").groupBy("lang").agg(n(train).alias("n_train"), n(~train).alias("n_test"), n(train & pos).alias("npos_train"), n(~train & pos).alias("npos_test"))


def unit_rows(t):
    """Order lines as units of a few hundred rows: one per supplier."""
    l = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    return l.select(F.col("l_suppkey").alias("unit"), *FEATURES, (F.col("l_extendedprice") / 10 + 500 * F.col("l_quantity")).alias("response"), "p_retailprice", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("key"))


def fits(t):
    return md.unit_fits(unit_rows(t), "unit", FEATURES, "response", "p_retailprice", "key", [10.0 ** (k / 2) for k in range(9)], 5, 1234)


@query(None)
def lasso_free_column(t):
    return fits(t).filter("arm = 'real'").select("unit", "feature", "coefficient", "strength", "status")


@query(None)
def robust_features(t):
    return fits(t).filter("robust").select("unit", "arm", "feature", "n_folds")


@query(None)
def permuted_control(t):
    return fits(t).groupBy("unit").agg(F.max(F.when(F.col("arm") == "real", F.col("p_base"))).alias("p_real"), F.max(F.when(F.col("arm") == "permuted", F.col("p_base"))).alias("p_permuted"))


@query(None)
def selected_features(t):
    return fits(t).filter("coefficient <> 0").select("unit", "arm", "feature", "coefficient", F.when(F.col("coefficient") > 0, "positive").otherwise("negative").alias("sign"))


def labelled_numbers(t):
    d = t("documents").join(t("labels"), "doc_id")
    x = d.select("doc_id", F.col("quality").cast("double").alias("label"), F.log1p("n_chars").alias("size"), F.try_divide(F.length(F.regexp_replace("text", "[^|$%&*#]", "")), F.col("n_chars")).alias("marks"), F.try_divide(F.length(F.regexp_replace("text", "[^ ]", "")), F.col("n_chars")).alias("spaces"))
    return md.class_weights(x.dropna(), "label")


@query(None)
def logistic_l1(t):
    df = labelled_numbers(t)
    model = md.logistic_l1(df, ["size", "marks", "spaces"], "label", "weight", 0.01).stages[-1]
    rows = list(zip(["size", "marks", "spaces"], map(float, model.coefficients.toArray())))
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


@query(None)
def forest_importance(t):
    df = labelled_numbers(t)
    model = md.forest(df, ["size", "marks", "spaces"], "label", "weight", trees=20).stages[-1]
    rows = list(zip(["size", "marks", "spaces"], map(float, model.featureImportances.toArray())))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


@query(None)
def seeded_sample(t):
    return rel.seeded_sample(t("orders").select("o_orderkey", "o_totalprice"), 500, 1234, ["o_orderkey"])


@query(None)
def permuted_response(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rel.permuted(o, ["o_custkey"], "o_totalprice", ["o_orderkey"], 1234, "permuted")
