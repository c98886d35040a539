"""Evaluation of predictions by algebra over grouped sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratawell.operators.ordered import attach, ranged, running, with_totals


def confusion(df: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """tp, fp, fn, tn, accuracy, balanced accuracy, precision, recall, f1, kappa and mcc per key; truth and predicted are 0/1."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = df.groupBy(*keys).agg(n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"), n(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    all_ = tp + fp + fn + tn
    recall, spec, precision = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp), F.try_divide(tp, tp + fp)
    accuracy = F.try_divide(tp + tn, all_)
    chance = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), all_ * all_)
    mcc = F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return out.withColumns({
        "accuracy": accuracy, "balanced_accuracy": (recall + spec) / 2, "precision": precision, "recall": recall,
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "kappa": F.try_divide(accuracy - chance, 1 - chance), "mcc": mcc,
    })


def auroc(df: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """Area under the ROC curve per key by average ranks; NULL if one class is missing."""
    tie = df.groupBy(*keys, score).agg(F.count("*").alias("__n"), F.sum(F.col(truth).cast("long")).alias("__pos"))
    ranked = running(ranged(tie, keys, [score]), keys, [score], "__r", F.col("__n")).withColumn("__r", F.col("__r") - (F.col("__n") - 1) / 2)
    s = ranked.groupBy(*keys).agg(F.sum(F.col("__pos") * F.col("__r")).alias("u"), F.sum("__pos").alias("n1"), F.sum(F.col("__n") - F.col("__pos")).alias("n0"))
    return s.select(*keys, F.try_divide(F.col("u") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1").cast("double") * F.col("n0")).alias("auroc"), "n1", "n0")


def _called(df: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """Per distinct score the cases and rows at or above it (tp, called), its own cases __pos and the totals __all and __rows."""
    tie = df.groupBy(*keys, score).agg(F.count("*").alias("__n"), F.sum(F.col(truth).cast("long")).alias("__pos"))
    points = running(ranged(tie, keys, [score]), keys, [score], "tp", F.col("__pos"), back=True)
    return with_totals(running(points, keys, [score], "called", F.col("__n"), back=True), keys, __all=F.sum("__pos"), __rows=F.sum("__n"))


def pr_points(df: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """Recall and precision at each distinct score, from the highest on."""
    points = _called(df, keys, truth, score)
    return points.select(*keys, F.col(score).alias("threshold"), "tp", "called", F.try_divide("tp", "__all").alias("recall"), F.try_divide("tp", "called").alias("precision"))


def pr_area(df: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """Average precision (step interpolation) per key; a score's own cases are its gain of recall."""
    p = _called(df, keys, truth, score)
    return p.groupBy(*keys).agg(F.sum(F.try_divide("__pos", "__all") * F.try_divide("tp", "called")).alias("pr_area"))


def roc_points(df: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """True and false positive rate at each distinct score; NULL where a class is missing."""
    p = _called(df, keys, truth, score)
    fp, negatives = F.col("called") - F.col("tp"), F.col("__rows") - F.col("__all")
    return p.select(*keys, F.col(score).alias("threshold"), F.try_divide("tp", "__all").alias("tpr"), F.try_divide(fp, negatives).alias("fpr"))


def by_fold(df: DataFrame, keys: list[str], fold: str, truth: str, predicted: str, score: str) -> DataFrame:
    """All classification metrics of each key and fold: of the calls, of the ranking, and log loss."""
    at = [*keys, fold]
    p = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = df.groupBy(*at).agg(F.avg(-F.log(F.when(F.col(truth) == 1, p).otherwise(1 - p))).alias("log_loss"))
    out = attach(confusion(df, at, truth, predicted), loss, at)
    return attach(attach(out, auroc(df, at, truth, score).select(*at, "auroc"), at), pr_area(df, at, truth, score), at)


def regression(df: DataFrame, keys: list[str], truth: str, predicted: str) -> list:
    """Aggregates n, r, r2, mse, rmse and mae for groupBy or groupingSets."""
    from stratawell.functions.safe_math import safe_corr

    t, p = F.col(truth), F.col(predicted)
    e = t - p
    mse = F.avg(e * e)
    return [F.count(e).alias("n"), safe_corr(t, p).alias("r"), (1 - F.try_divide(F.sum(e * e), F.var_pop(F.when(e.isNotNull(), t)) * F.count(e))).alias("r2"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae")]


def two_level_regression(df: DataFrame, keys: list[str], fold: str, truth: str, predicted: str) -> DataFrame:
    """Regression metrics per key and fold, and over all folds as fold 0 (folds count from 1)."""
    out = df.groupingSets([[*keys, fold], keys], *keys, fold).agg(F.grouping(fold).alias("__g"), *regression(df, keys, truth, predicted))
    return out.withColumn(fold, F.when(F.col("__g") == 1, F.lit(0)).otherwise(F.col(fold))).drop("__g")
