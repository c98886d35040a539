"""Ranks, running sums and running minima within keys, for keys of any size.

A plain window puts all rows of a key in one task.  Here rows are ranged by
(keys, order) over all tasks and written once; sums and minima of each
(key, range) are carried to the ranges after it, and a window runs inside a
range only.  The carried table has a row per key and range it meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stratawell.session import stash


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with its range number __p, written once; rows of equal order stay within a range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stash(df.repartitionByRange(parts, *keys, *order).withColumn("__p", F.spark_partition_id()), "ranged")


def attach(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of small (unique by keys); missing keys match missing ones."""
    b = small.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(b, on).drop(*[f"__k_{k}" for k in keys])


def with_totals(df: DataFrame, keys: list[str], **totals: Column) -> DataFrame:
    """df with aggregates of its key, by a pre-aggregated join instead of a window."""
    t = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    return attach(df, t, keys) if keys else df.join(t)  # without keys t is one row


def running(df: DataFrame, keys: list[str], order: list[str], name: str, value: Column, least: bool = False, back: bool = False) -> DataFrame:
    """df (ranged) with the sum (or minimum) of value over the rows up to this one, or from it on, in the order within keys."""
    fold = F.min if least else F.sum
    asc = lambda c: F.col(c).desc() if back else F.col(c).asc()
    part = df.groupBy(*keys, "__p").agg(fold(value).alias("__v"))
    before = W.partitionBy(*keys).orderBy(asc("__p")).rowsBetween(W.unboundedPreceding, -1)
    carried = part.select(*keys, "__p", fold("__v").over(before).alias("__c"))
    inside = W.partitionBy(*keys, "__p").orderBy(*[asc(c) for c in order]).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = attach(df.withColumn("__i", fold(value).over(inside)), carried, [*keys, "__p"])
    both = F.least("__i", "__c") if least else F.col("__i") + F.coalesce("__c", F.lit(0))
    return out.withColumn(name, both).drop("__i", "__c")


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with the rank of value within keys, ties averaged."""
    tie = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    t = running(ranged(tie, keys, [value]), keys, [value], "__r", F.col("__n"))
    t = t.select(*keys, value, (F.col("__r") - (F.col("__n") - 1) / 2).alias(name))
    return attach(df, t, [*keys, value])
