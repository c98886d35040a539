"""Splits, folds, training-only preprocessing and penalised fits with negative controls.

Relational steps are DataFrame expressions; many small fits run as grouped maps
(one group per unit), large single fits through Spark ML.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stratawell.operators.ordered import attach, with_totals
from stratawell.operators.stats import f_tail


def holdout(df: DataFrame, groups: dict[str, list]) -> DataFrame:
    """df with in_<column> flags, test (any flag) and strict_test (all flags); train is the rest."""
    flags = {f"in_{c}": F.coalesce(F.col(c).isin(v), F.lit(False)) for c, v in groups.items()}
    df = df.withColumns(flags)
    any_, all_ = F.lit(False), F.lit(True)
    for f in flags:
        any_, all_ = any_ | F.col(f), all_ & F.col(f)
    return df.withColumns({"test": any_, "strict_test": all_})


def share_holdout(df: DataFrame, group: str, share: float, seed: int | None) -> DataFrame:
    """Groups, in pseudo-random order (by name if seed is None), whose rows first reach the share of all rows."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    run = W.orderBy(*([] if seed is None else [F.xxhash64(F.lit(seed), group)]), group).rowsBetween(W.unboundedPreceding, W.currentRow)
    sizes = sizes.withColumns({"before": F.sum("n").over(run) - F.col("n"), "all": F.sum("n").over(W.partitionBy())})
    return sizes.filter(F.col("before") < share * F.col("all")).select(group)


def dichotomised(df: DataFrame, column: str, low: float, high: float, names: tuple[str, str], name: str = "class") -> DataFrame:
    """Rows at or below low and at or above high with their class; the middle is dropped."""
    return df.withColumn(name, F.when(F.col(column) <= low, names[0]).when(F.col(column) >= high, names[1])).dropna(subset=[name])


def imputed_scaled(long: DataFrame, train: Column, feature: str = "feature", value: str = "value") -> DataFrame:
    """long with imputed (training mean for missing) and scaled (training mean and sample sd after imputation)."""
    v = F.when(train, F.col(value))
    # Filling in the mean leaves it as it is and adds nothing to the squared deviations: one pass gives both.
    seen = long.groupBy(feature).agg(F.avg(v).alias("__mean"), (F.var_pop(v) * F.count(v)).alias("__dev"), F.count(F.when(train, 1)).alias("__n"))
    seen = seen.select(feature, "__mean", F.sqrt(F.try_divide("__dev", F.col("__n") - 1)).alias("__sd"))
    out = long.join(seen, feature).withColumn("imputed", F.coalesce(F.col(value), F.col("__mean")))
    return out.withColumn("scaled", F.try_divide(F.col("imputed") - F.col("__mean"), "__sd")).drop("__mean", "__sd")


def response_scaled(df: DataFrame, response: str, train: Column, keys: list[str], name: str = "scaled_response") -> DataFrame:
    """df with the response centred and scaled by mean and sample sd of its key's training rows; NULL if they don't vary."""
    v = F.when(train, F.col(response))
    t = with_totals(df, keys, __mean=F.avg(v), __sd=F.stddev_samp(v))
    return t.withColumn(name, F.try_divide(F.col(response) - F.col("__mean"), F.nullif(F.col("__sd"), F.lit(0.0)))).drop("__mean", "__sd")


def group_folds(df: DataFrame, group: str, k: int, seed: int | None) -> DataFrame:
    """group and fold (1 to k): groups in descending size, dealt forth and back, so folds are near equal.

    Groups of equal size come in pseudo-random order, or by their name if seed is None.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    tie = [] if seed is None else [F.xxhash64(F.lit(seed), group)]
    place = F.row_number().over(W.orderBy(F.col("n").desc(), *tie, group)) - 1
    lap, at = F.floor(place / k), place % k
    return sizes.select(group, F.when(lap % 2 == 0, at + 1).otherwise(F.lit(k) - at).cast("int").alias("fold"))


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Rows over rows of the class."""
    n = with_totals(df.groupBy(label).agg(F.count("*").alias("__n")), [], __all=F.sum("__n"))
    return attach(df, n.select(label, (F.col("__all") / F.col("__n")).alias(name)), [label])


def one_se(grid: DataFrame, keys: list[str], strength: str, metric: str, sd: str, folds: int) -> DataFrame:
    """Per key the largest strength whose metric is within one standard error of the best."""
    best = W.partitionBy(*keys).orderBy(F.col(metric).desc(), F.col(strength).desc())
    top = grid.withColumn("__n", F.row_number().over(best)).filter("__n = 1").select(*keys, (F.col(metric) - F.col(sd) / F.sqrt(F.lit(folds))).alias("__least"))
    return grid.join(top, keys).filter(F.col(metric) >= F.col("__least")).groupBy(*keys).agg(F.max(strength).alias(strength))


# ----- fits of one unit, in numpy -----


def lasso_path(x: np.ndarray, y: np.ndarray, free: np.ndarray | None, grid: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Coefficients (len(grid), features) of a lasso on scaled columns; free columns go in without penalty.

    Features are scaled, then features and response lose what the free columns (and the mean) explain.
    """
    base = np.column_stack([np.ones(len(y)), *([free] if free is not None else [])])
    sd = x.std(axis=0, ddof=0)
    sd[sd == 0] = 1
    z = x / sd
    z = z - base @ np.linalg.lstsq(base, z, rcond=None)[0]
    r0 = y - base @ np.linalg.lstsq(base, y, rcond=None)[0]
    n, p = z.shape
    norm = (z * z).sum(axis=0) / n
    w, out, r = np.zeros(p), np.zeros((len(grid), p)), r0.copy()
    for k, lam in sorted(enumerate(grid), key=lambda t: -t[1]):
        for _ in range(rounds):
            moved = 0.0
            for j in range(p):
                if norm[j] < 1e-12:
                    continue
                rho = z[:, j] @ r / n + norm[j] * w[j]
                new = np.sign(rho) * max(abs(rho) - lam, 0) / norm[j]
                if new != w[j]:
                    r -= z[:, j] * (new - w[j])
                    moved, w[j] = max(moved, abs(new - w[j])), new
            if moved < 1e-9:
                break
        out[k] = w / sd
    return out


def lasso_one_se(x, y, free, grid, fold) -> tuple[float, np.ndarray, np.ndarray]:
    """The one-standard-error strength over the folds, its coefficients, and those of each fold."""
    grid, folds = np.asarray(grid), np.unique(fold)
    error, chosen = np.zeros((len(folds), len(grid))), []
    for i, f in enumerate(folds):
        a, b = fold != f, fold == f
        w = lasso_path(x[a], y[a], None if free is None else free[a], grid)
        base = lambda m: np.column_stack([np.ones(m.sum()), *([free[m]] if free is not None else [])])
        for k in range(len(grid)):
            c = np.linalg.lstsq(base(a), y[a] - x[a] @ w[k], rcond=None)[0]
            error[i, k] = np.mean((y[b] - x[b] @ w[k] - base(b) @ c) ** 2)
        chosen.append(w)
    mean, se = error.mean(axis=0), error.std(axis=0, ddof=1) / np.sqrt(len(folds))
    best = int(mean.argmin())
    k = max((k for k in range(len(grid)) if mean[k] <= mean[best] + se[best]), key=lambda k: grid[k])
    return float(grid[k]), lasso_path(x, y, free, grid)[k], np.array([w[k] for w in chosen])


def robust(full: np.ndarray, by_fold: np.ndarray) -> np.ndarray:
    """Features that the full fit and at least two fold fits select."""
    return (full != 0) & ((by_fold != 0).sum(axis=0) >= 2)


UNIT_FIT = "unit string, arm string, rotated boolean, feature string, coefficient double, n_folds int, folds array<int>, robust boolean, strength double, n long, p_base double, p_free double, status string"


def unit_fits(df: DataFrame, unit: str, features: list[str], response: str, free: str | None, key: str, grid: list[float], folds: int, seed: int, rotated: bool = False, only: str | None = None) -> DataFrame:
    """Per unit, a real and a permuted arm: lasso with one-SE strength, robust features and nested F tests.

    Rotated units have no permuted arm: that cell of the design is not fitted.  only names a column that holds the
    list of features a unit may use (equal in all its rows); without it a unit uses all.
    A unit is one group of rows and has to fit one task; what fails in a unit is told in status, the
    others go on.  Units need more rows than features used and a response that varies.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        name, rows = str(pdf[unit].iloc[0]), []
        use = pdf.dropna(subset=[response, *features, *([free] if free else [])]).sort_values([key, response, *features])
        allowed = set(pdf[only].iloc[0]) if only else set(features)
        names = [f for f in features if f in allowed]
        x = use[names].to_numpy(float)
        r = np.random.default_rng([seed, abs(hash_text(name)) % 2**32])
        z = use[free].to_numpy(float)[:, None] if free else None
        for arm in ("real",) if rotated else ("real", "permuted"):
            y = use[response].to_numpy(float)
            y = y if arm == "real" else r.permutation(y)
            row = {"unit": name, "arm": arm, "rotated": rotated, "n": len(y), "status": "ok"}
            try:
                if len(y) < max(10, folds) or np.std(y) == 0:
                    raise ValueError("too few rows" if len(y) < max(10, folds) else "the response does not vary")
                if not names:
                    raise ValueError("no feature may be used")
                strength, w, by_fold = lasso_one_se(x, y, z, grid, np.arange(len(y)) % folds + 1)
                sse = lambda cols: float(((y - cols @ np.linalg.lstsq(cols, y, rcond=None)[0]) ** 2).sum())
                one = np.ones((len(y), 1))
                sel = x[:, w != 0]
                s0, s1 = sse(one), sse(np.column_stack([one, sel])) if sel.shape[1] else None
                q, d = sel.shape[1], len(y) - sel.shape[1] - 1
                test = lambda a, b, m, d: f_tail((a - b) / m / (b / d), m, d) if d > 0 and m > 0 and b > 0 else None
                row["p_base"] = test(s0, s1, q, d) if q else None
                row["p_free"] = test(s1, sse(np.column_stack([one, sel, z])), 1, d - 1) if q and z is not None else None
                row["strength"] = strength
                strong = robust(w, by_fold)
                rows += [row | {"feature": f, "coefficient": float(c), "n_folds": int((by_fold[:, i] != 0).sum()), "folds": [int(k) + 1 for k in np.flatnonzero(by_fold[:, i])], "robust": bool(strong[i])} for i, (f, c) in enumerate(zip(names, w))]
            except Exception as e:
                rows.append(row | {"status": f"{type(e).__name__}: {e}"[:200]})
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in UNIT_FIT.split(", ")])
        return pd.DataFrame({c: pd.Series([v if isinstance(v, list) else None if pd.isna(v) else v for v in out[c]], dtype=object) for c in out})

    return df.groupBy(unit).applyInPandas(fit, UNIT_FIT)


def fold_features(fits: DataFrame) -> DataFrame:
    """A row per unit, arm, fold and feature that the fold's fit selects."""
    return fits.filter("size(folds) > 0").select("unit", "arm", "rotated", "feature", F.explode("folds").alias("fold"))


def hash_text(x: str) -> int:
    import zlib

    return zlib.crc32(x.encode())


def rotations(units: DataFrame, same: list[str], differ: str, key: str, n: int, seed: int | None) -> DataFrame:
    """Up to n other units for each: equal in the columns same, different in differ, spread evenly over those.

    Units of a group stand in a row, those of equal differ together, in pseudo-random order (by key if seed
    is None).  A unit's donors are every (m / n)-th of the m units outside its own stretch, from a start of
    its own, so a group of any size gives n rows a unit and no table of all pairs.
    """
    order = [F.xxhash64(F.lit(seed), key)] if seed is not None else []
    group = W.partitionBy(*same)
    mine = W.partitionBy(*same, differ)
    u = units.select(*same, differ, key).filter(F.col(differ).isNotNull() & F.col(key).isNotNull())
    u = u.withColumn("__at", F.row_number().over(group.orderBy(differ, *order, key)) - 1)
    u = u.withColumns({"__m": F.count("*").over(group) - F.count("*").over(mine), "__c": F.count("*").over(mine), "__s": F.min("__at").over(mine)})
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), key), F.col("__m")) if seed is not None else F.pmod(F.col("__at"), F.col("__m"))
    j = F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("__m")).cast("int") - 1))
    step = F.greatest(F.lit(1), F.floor(F.col("__m") / n))
    want = u.filter("__m > 0").withColumn("__first", start).select(*same, key, "__m", "__c", "__s", "__first", step.alias("__t"), j.alias("__j"))
    place = F.pmod(F.col("__first") + F.col("__j") * F.col("__t"), F.col("__m"))
    want = want.withColumn("__at", F.when(place < F.col("__s"), place).otherwise(place + F.col("__c")))
    donors = u.select(*same, "__at", F.col(key).alias("donor"))
    return attach(want, donors, [*same, "__at"]).select(key, "donor", (F.col("__j") + 1).alias("rotation"))


def logistic_l1(df: DataFrame, features: list[str], label: str, weight: str | None, strength: float):
    """A class-weighted logistic regression with L1 penalty on standardised features: pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=strength, elasticNetParam=1.0, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), lr]).fit(df)


def forest(df: DataFrame, features: list[str], label: str, weight: str | None = None, trees: int = 200, seed: int = 1234, per_split: str = "sqrt"):
    """A random forest with Gini splits and at least ten rows a node: pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, minInstancesPerNode=10, featureSubsetStrategy=per_split, seed=seed, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), rf]).fit(df)


def fractional_logit(df: DataFrame, features: list[str], response: str):
    """A binomial-logit regression of a response in [0, 1]: pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    glm = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features", labelCol=response)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), glm]).fit(df)
