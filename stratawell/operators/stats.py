"""Grouped correlations, rank statistics, dispersion, false-discovery control, F tests."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stratawell.functions.safe_math import pairs, partial, safe_corr
from stratawell.operators.ordered import attach, average_ranks, ranged, running, with_totals


def correlations(long: DataFrame, keys: list[str], y: str, minimum: int, feature: str = "feature", value: str = "value") -> DataFrame:
    """r and n per key and feature; r is NULL below minimum complete pairs."""
    v, r = F.col(value), F.col(y)
    out = long.groupBy(*keys, feature).agg(safe_corr(v, r).alias("r"), pairs(v, r).alias("n"))
    return out.withColumn("r", F.when(F.col("n") >= minimum, F.col("r")))


def two_level_correlations(long: DataFrame, keys: list[str], level: str, y: str, minimum: int, feature: str = "feature", value: str = "value") -> DataFrame:
    """correlations() by keys and level, and by keys alone under the level "All", in one pass."""
    v, r = F.col(value), F.col(y)
    both = long.groupingSets([[*keys, feature, level], [*keys, feature]], *keys, feature, level)
    out = both.agg(F.grouping(level).alias("__g"), safe_corr(v, r).alias("r"), pairs(v, r).alias("n"))
    out = out.withColumn(level, F.when(F.col("__g") == 1, F.lit("All")).otherwise(F.col(level)))
    return out.select(*keys, level, feature, F.when(F.col("n") >= minimum, F.col("r")).alias("r"), "n")


def partial_correlations(long: DataFrame, keys: list[str], y: str, control: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """Correlation of each feature with y given the control column, over complete rows.

    A feature of the control's name keeps its plain correlation.
    """
    whole = F.col(value).isNotNull() & F.col(y).isNotNull() & F.col(control).isNotNull()
    v, r, c = F.col(value), F.col(y), F.col(control)
    three = long.filter(whole).groupBy(*keys, feature).agg(safe_corr(v, r).alias("xy"), safe_corr(v, c).alias("xz"), safe_corr(r, c).alias("yz"))
    return three.select(*keys, feature, F.when(F.col(feature) == control, F.col("xy")).otherwise(partial(F.col("xy"), F.col("xz"), F.col("yz"))).alias("r"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation per key over complete pairs."""
    whole = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = average_ranks(average_ranks(whole, keys, x, "a"), keys, y, "b")
    return ranked.groupBy(*keys).agg(safe_corr(F.col("a"), F.col("b")).alias("r"), F.count("*").alias("n"))


def tau_b(x: np.ndarray, y: np.ndarray) -> float | None:
    """Kendall's tau-b, ties in either side taken out; None for a constant side.

    Discordant pairs are inversions of y in the order of (x, y), counted block by block in sorted order.
    """
    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    tied = lambda *v: int(sum(k * (k - 1) // 2 for k in np.diff(np.flatnonzero(np.concatenate([[True], np.any([a[1:] != a[:-1] for a in v], axis=0), [True]]))).tolist()))
    all_, in_x, in_both, in_y = n * (n - 1) // 2, tied(x), tied(x, y), tied(np.sort(y))
    if n < 2 or all_ == in_x or all_ == in_y:
        return None
    at, width, wrong = np.arange(n), 1, 0
    while width < n:
        block, right = at // (2 * width), (at // width) % 2
        o = np.lexsort((right, y, block))
        left = np.cumsum(1 - right[o])
        ends = np.append(np.flatnonzero(np.diff(block[o])), n - 1)
        wrong += int(((left[ends][block[o]] - left) * right[o]).sum())
        width *= 2
    return float((all_ - in_x - in_y + in_both - 2 * wrong) / (math.sqrt(all_ - in_x) * math.sqrt(all_ - in_y)))


def coefficients(df: DataFrame, keys: list[str], x: str, y: str, method: str) -> DataFrame:
    """r and n per key over complete pairs; method is pearson, spearman or kendall (then a key's rows have to fit a task)."""
    whole = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    if method == "pearson":
        return whole.groupBy(*keys).agg(safe_corr(F.col("__x"), F.col("__y")).alias("r"), F.count("*").alias("n"))
    if method == "spearman":
        return spearman(whole, keys, "__x", "__y")
    if method != "kendall":
        raise ValueError(f"unknown method {method}")
    types = dict(whole.dtypes)

    def tau(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[keys].iloc[:1].copy()
        out["r"] = pd.Series([tau_b(pdf["__x"].to_numpy(), pdf["__y"].to_numpy())], index=out.index, dtype=object)
        out["n"] = len(pdf)
        return out

    return whole.groupBy(*keys).applyInPandas(tau, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", r double, n bigint")


def both_levels(df: DataFrame, level: str) -> DataFrame:
    """Each row under its own level and under "All"."""
    return df.withColumn(level, F.explode(F.array(F.col(level).cast("string"), F.lit("All"))))


def _gated(df: DataFrame, keys: list[str], whole: Column, minimum: int) -> DataFrame:
    """Complete rows of the groups that have at least minimum of them."""
    some = df.filter(whole)
    good = some.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") >= minimum).drop("__n")
    return attach(some, good.withColumn("__ok", F.lit(True)), keys).drop("__ok")


def method_correlations(long: DataFrame, keys: list[str], level: str, y: str, minimum: int, methods: tuple[str, ...], feature: str = "feature", value: str = "value") -> DataFrame:
    """method, r and n per key, level (and "All") and feature with at least minimum complete pairs."""
    group = [*keys, level, feature]
    rows = _gated(both_levels(long, level), group, F.col(value).isNotNull() & F.col(y).isNotNull(), minimum)
    parts = [coefficients(rows, group, value, y, m).withColumn("method", F.lit(m)) for m in methods]
    return reduce(DataFrame.unionByName, parts)


def method_partial_correlations(long: DataFrame, keys: list[str], level: str, y: str, control: str, minimum: int, methods: tuple[str, ...], feature: str = "feature", value: str = "value") -> DataFrame:
    """method, r and n of each feature with y given the control column, as method_correlations, over complete triples.

    A feature of the control's name keeps its plain coefficient.
    """
    group = [*keys, level, feature]
    whole = F.col(value).isNotNull() & F.col(y).isNotNull() & F.col(control).isNotNull()
    rows, parts = _gated(both_levels(long, level), group, whole, minimum), []
    for m in methods:
        xy = coefficients(rows, group, value, y, m).withColumnRenamed("r", "__xy")
        xz = coefficients(rows, group, value, control, m).select(*group, F.col("r").alias("__xz"))
        yz = coefficients(rows, group, y, control, m).select(*group, F.col("r").alias("__yz"))
        three = attach(attach(xy, xz, group), yz, group)
        r = F.when(F.col(feature) == control, F.col("__xy")).otherwise(partial(F.col("__xy"), F.col("__xz"), F.col("__yz")))
        parts.append(three.select(*group, r.alias("r"), "n", F.lit(m).alias("method")))
    return reduce(DataFrame.unionByName, parts)


def adjusted_p(df: DataFrame, keys: list[str], p: str, tie: list[str], name: str = "adjusted") -> DataFrame:
    """Benjamini-Hochberg p-values within keys; missing p-values stay missing and do not count."""
    some, none = df.filter(F.col(p).isNotNull()), df.filter(F.col(p).isNull())
    placed = running(ranged(some, keys, [p, *tie]), keys, [p, *tie], "__rank", F.lit(1))
    placed = with_totals(placed, keys, __n=F.count("*"))
    placed = placed.withColumn("__q", F.col(p) * F.col("__n") / F.col("__rank"))
    out = running(placed, keys, [p, *tie], name, F.col("__q"), least=True, back=True)
    out = out.withColumn(name, F.least(F.lit(1.0), name))
    return out.select(*df.columns, name).unionByName(none.withColumn(name, F.lit(None).cast("double")))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (Lentz), all elements at once."""
    safe = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c, d = np.ones(len(x)), 1 / safe(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / safe(1 + top * d)
            c = safe(1 + top / c)
            h *= d * c
        if (np.abs(d * c - 1) < 1e-14).all():
            break
    return h


def f_tails(f: np.ndarray, df1: np.ndarray, df2: np.ndarray) -> np.ndarray:
    """P(F > f) of each element; NaN where a value is missing or a freedom is not above 0."""
    out = np.full(len(f), np.nan)
    on = ~(np.isnan(f) | np.isnan(df1) | np.isnan(df2)) & (df1 > 0) & (df2 > 0)
    out[on & (f <= 0)] = 1.0
    on &= f > 0
    if on.any():
        gamma = np.vectorize(math.lgamma)
        a, b, x = df2[on] / 2, df1[on] / 2, df2[on] / (df2[on] + df1[on] * f[on])
        inner = (x > 0) & (x < 1)
        z = np.where(inner, x, 0.5)
        front = np.where(inner, np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(z) + b * np.log1p(-z)), 0.0)
        low = x < (a + 1) / (a + b + 2)
        p, q, t = np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1 - x)
        part = front * _beta_fraction(p, q, t) / p
        out[on] = np.where(low, part, 1 - part)
    return out


def f_tail(f: float | None, df1: float | None, df2: float | None) -> float | None:
    """P(F > f)."""
    if f is None or df1 is None or df2 is None:
        return None
    p = f_tails(np.array([f], float), np.array([df1], float), np.array([df2], float))[0]
    return None if np.isnan(p) else float(p)


def f_p_value(f: str, df1: str, df2: str) -> Column:
    """P(F > f) of columns, in Arrow batches."""

    def tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
        return pd.Series(f_tails(f.to_numpy(float), df1.to_numpy(float), df2.to_numpy(float)))

    return F.pandas_udf(tail, "double")(f, df1, df2)


def simple_regression(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """n, slope, intercept, sse (with x) and sst (intercept alone) per key, by sums in one pass."""
    n, sxx, syy, sxy = F.count("*"), F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    whole = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = whole.groupBy(*keys).agg(n.alias("n"), sxx.alias("sxx"), syy.alias("syy"), sxy.alias("sxy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    slope = F.try_divide("sxy", "sxx")
    return s.select(*keys, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), (F.col("n") * (F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), "sxx"))).alias("sse"), (F.col("n") * F.col("syy")).alias("sst"))


def nested_f(fits: DataFrame, added: int = 1, used: int = 2) -> DataFrame:
    """fits with f, df1 and df2 of the test of the larger against the smaller model; NULL where no freedom is left."""
    df2 = F.col("n") - used
    f = F.when(df2 > 0, F.try_divide((F.col("sst") - F.col("sse")) / added, F.col("sse") / df2))
    return fits.withColumns({"f": f, "df1": F.lit(float(added)), "df2": df2.cast("double")})


def label_calls(df: DataFrame, first: str, second: str, alpha: float = 0.05) -> DataFrame:
    """call: what the adjusted p-values of two nested tests say; a missing second test stays apart."""
    call = F.when(F.col(first).isNull(), "not tested").when(F.col(first) > alpha, "no signal").when(F.col(second).isNull(), "signal, second not tested")
    return df.withColumn("call", call.when(F.col(second) <= alpha, "signal and more").otherwise("signal"))


def solve_normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(x, y, rcond=None)[0]
