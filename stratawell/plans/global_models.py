"""Genome-wide classifiers: group hold-out, training-only preprocessing, real and permuted arms, metrics on three test slices."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from stratawell.config import Settings
from stratawell.operators import evaluation as evl, modelling as md, relational as rel
from stratawell.operators.ordered import with_totals
from stratawell.session import stash

ARMS = ("real", "permuted")
SLICES = {"first_only": "in_first AND NOT in_second", "second_only": "in_second AND NOT in_first", "both": "strict_test"}


def usable(df: DataFrame, features: list[str]) -> list[str]:
    """Features that have values and vary."""
    row = df.agg(*[F.stddev_samp(f"`{f}`").alias(str(i)) for i, f in enumerate(features)]).first()
    return [f for f, sd in zip(features, row) if sd is not None and sd > 0]


def preprocess(train: DataFrame, features: list[str]):
    """Mean imputation and scaling fitted on the training rows: pipeline model that adds "features"."""
    filled = [f"__i{i}" for i in range(len(features))]
    return Pipeline(stages=[
        Imputer(strategy="mean", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="__raw"),
        StandardScaler(withMean=True, withStd=True, inputCol="__raw", outputCol="features"),
    ]).fit(train)


def split(df: DataFrame, first: tuple[str, list], second: tuple[str, list], response: str, settings: Settings) -> DataFrame:
    """Rows with class, label (1 for case), in_first, in_second, test and strict_test."""
    h = md.holdout(df, {first[0]: first[1], second[0]: second[1]})
    h = h.withColumnsRenamed({f"in_{first[0]}": "in_first", f"in_{second[0]}": "in_second"})
    d = md.dichotomised(h, response, settings.low, settings.high, (settings.control_class, settings.case_class))
    return d.withColumn("label", (F.col("class") == settings.case_class).cast("double"))


def logistic(df: DataFrame, strength: float, label: str, features: str = "features"):
    return LogisticRegression(featuresCol=features, labelCol=label, weightCol="weight", regParam=strength, elasticNetParam=1.0 if strength else 0.0).fit(df)


def balanced_accuracy(df: DataFrame, label: str) -> float:
    p = df.select(F.col(label).cast("int").alias("t"), F.col("prediction").cast("int").alias("p"))
    return evl.confusion(p, [], "t", "p").first().balanced_accuracy or 0.0


def one_se_strength(train: DataFrame, label: str, folds: int, grid: tuple[float, ...], metric: Callable[[DataFrame, str], float] = balanced_accuracy, parallel: int = 4) -> float:
    """The largest strength within one standard error of the best mean metric over the folds.

    metric takes scored rows and the label's name; larger is better.  So many fits run at once; each is a Spark job.
    """

    def fit(at: tuple[float, int]) -> float:
        g, k = at
        return metric(logistic(train.filter(F.col("fold") != k), g, label).transform(train.filter(F.col("fold") == k)), label)

    cells = [(g, k) for g in grid for k in range(1, folds + 1)]
    with ThreadPoolExecutor(parallel) as pool:
        values = dict(zip(cells, pool.map(fit, cells)))
    rows = []
    for g in grid:
        got = [values[g, k] for k in range(1, folds + 1)]
        mean = sum(got) / folds
        sd = (sum((x - mean) ** 2 for x in got) / max(1, folds - 1)) ** 0.5
        rows.append(("m", float(g), mean, sd))
    table = train.sparkSession.createDataFrame(rows, "k string, strength double, metric double, sd double")
    return md.one_se(table, ["k"], "strength", "metric", "sd", folds).first().strength


def scored(fitted, rows: DataFrame, label: str, **names: str) -> DataFrame:
    out = fitted.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return out.select(*[F.lit(v).alias(k) for k, v in names.items()], F.col(label).cast("int").alias("truth"), F.col("prediction").cast("int").alias("predicted"), "score", "in_first", "in_second", "strict_test")


def run_global(df: DataFrame, key: str, group: str, features: list[str], response: str, first: tuple[str, list], second: tuple[str, list], settings: Settings, trees: int = 200, per_split: tuple[str, ...] = ("sqrt",)) -> dict[str, DataFrame]:
    """Tables predictions, coefficients, importances and sizes of one configuration.

    key names a row, group the column whose values stay in one fold.  Rows of a hold-out group never train.
    """
    d = stash(split(df, first, second, response, settings), "split")
    train = d.filter("NOT test")
    names = usable(train, features)
    if not names or train.select("label").distinct().count() < 2:
        raise ValueError("no usable feature, or one class only, in the training rows")
    prepared = preprocess(train, names)
    fold = md.group_folds(train, group, settings.global_folds, settings.seed)
    train = with_totals(train.join(fold, group), ["label"], __n=F.count("*"))
    n = train.count()
    train = prepared.transform(train.withColumn("weight", F.lit(float(n)) / F.col("__n")))
    train = stash(rel.permuted(train.withColumn("__g", F.lit(1)), ["__g", "fold"], "label", [key], settings.seed, "permuted_label").select(key, "label", "permuted_label", "features", "fold", "weight"), "train")
    test = prepared.transform(d.filter("test"))
    predictions, coefficients, importances = [], [], []
    spark = df.sparkSession
    for arm, label in zip(ARMS, ("label", "permuted_label")):
        strength = one_se_strength(train, label, settings.global_folds, settings.lambda_grid)
        lasso = logistic(train, strength, label)
        picked = [i for i, c in enumerate(lasso.coefficients.toArray()) if c != 0]
        fits = {"l1": lasso}
        if picked:
            from pyspark.ml.feature import VectorSlicer

            cut = VectorSlicer(inputCol="features", outputCol="picked", indices=picked)
            free = LogisticRegression(featuresCol="picked", labelCol=label, weightCol="weight").fit(cut.transform(train))
            predictions.append(scored(free, cut.transform(test), "label", arm=arm, model="selected"))
            coefficients += [(arm, "selected", names[i], float(c), strength) for i, c in zip(picked, free.coefficients.toArray())]
        best = max(per_split, key=lambda s: balanced_accuracy(forest(train.filter("fold <> 1"), label, trees, settings.seed, s).transform(train.filter("fold = 1")), label)) if len(per_split) > 1 else per_split[0]
        fits["forest"] = forest(train, label, trees, settings.seed, best)
        predictions += [scored(m, test, "label", arm=arm, model=k) for k, m in fits.items()]
        coefficients += [(arm, "l1", f, float(c), strength) for f, c in zip(names, lasso.coefficients.toArray())]
        importances += [(arm, f, float(v)) for f, v in zip(names, fits["forest"].featureImportances.toArray())]
    p = stash(reduce(lambda a, b: a.unionByName(b), predictions), "predictions")
    size = lambda f, pos: F.count(F.when(f & (F.col("label") == 1), 1) if pos else F.when(f, 1))
    t = F.col("test")
    return {
        "predictions": p, "metrics": metrics(p),
        "coefficients": spark.createDataFrame(coefficients, "arm string, model string, feature string, coefficient double, strength double"),
        "importances": spark.createDataFrame(importances, "arm string, feature string, importance double"),
        "sizes": d.agg(size(~t, False).alias("n_train"), size(t, False).alias("n_test"), size(~t, True).alias("npos_train"), size(t, True).alias("npos_test")),
    }


def forest(df: DataFrame, label: str, trees: int, seed: int, per_split: str):
    return RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight", numTrees=trees, minInstancesPerNode=10, featureSubsetStrategy=per_split, seed=seed).fit(df)


def metrics(predictions: DataFrame) -> DataFrame:
    """Confusion metrics, AUROC and average precision by arm, model and test slice."""
    keys = ["arm", "model", "slice"]
    rows = rel.stacked({k: predictions.filter(cond) for k, cond in SLICES.items()}, "slice")
    c, a, p = evl.confusion(rows, keys, "truth", "predicted"), evl.auroc(rows, keys, "truth", "score"), evl.pr_area(rows, keys, "truth", "score")
    return c.join(a, keys).join(p, keys)


def baselines(sizes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """What a guess reaches: 0.5 for AUROC and balanced accuracy, 0 for kappa and MCC, the share of cases for precision."""
    share = F.try_divide("npos_test", "n_test")
    return sizes.select(*keys, F.lit(0.5).alias("auroc"), F.lit(0.5).alias("balanced_accuracy"), F.lit(0.0).alias("kappa"), F.lit(0.0).alias("mcc"), share.alias("pr_area"), F.greatest(share, 1 - share).alias("accuracy"))
