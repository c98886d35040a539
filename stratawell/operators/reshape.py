"""Wide to long and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def to_long(df: DataFrame, ids: list[str], values: list[str], name: str = "feature", value: str = "value", drop_missing: bool = False) -> DataFrame:
    """One row per id and column; columns are cast to double."""
    out = df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in values]).unpivot(ids, [F.col(f"`{c}`") for c in values], name, value)
    return out.filter(F.col(value).isNotNull()) if drop_missing else out


def to_wide(df: DataFrame, ids: list[str], name: str, value: str, names: list[str], fill: float | None = None) -> DataFrame:
    """A column per known name, by conditional aggregation in one pass; the value is unique per id and name, else its maximum."""
    out = df.groupBy(*ids).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])
    return out.fillna(fill, subset=names) if fill is not None else out


def usable_features(long: DataFrame, feature: str = "feature", value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Names of features that have values and vary, per key."""
    return long.groupBy(*keys, feature).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd")).filter("n > 0 AND sd > 0").select(*keys, feature)


def families(long: DataFrame, prefixes: dict[str, str], other: str, feature: str = "feature", name: str = "family") -> DataFrame:
    """A family label by name prefix."""
    label = F.lit(other)
    for p, v in prefixes.items():
        label = F.when(F.col(feature).startswith(p), F.lit(v)).otherwise(label)
    return long.withColumn(name, label)
