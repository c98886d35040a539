"""Closed integer intervals: overlap, gaps, points, coverage, flanks.

Joins put intervals into bins of fixed width and meet on (keys, bin), with the
range test as residual; a pair is kept only in the bin of the later start, so no
distinct is needed.  Long intervals take several bins, hot keys are split by
adaptive skew handling of the plain shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _binned(df: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    first, last = F.floor(start / width), F.floor(end / width)
    return df.filter(start <= end).withColumn("__bin", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, gap: int | None = None, start: str = "start", end: str = "end", suffix: str = "_2") -> DataFrame:
    """Pairs of rows with equal keys whose intervals share a place, or lie within gap places of each other.

    Columns of right get the suffix, but for the keys.  gap counts the places strictly between; touching is 0.
    """
    grow = 0 if gap is None else gap + 1
    a = _binned(left, F.col(start) - grow, F.col(end) + grow, width)
    r = right.select(*keys, *[F.col(c).alias(c + suffix) for c in right.columns if c not in keys])
    s2, e2 = F.col(start + suffix), F.col(end + suffix)
    b = _binned(r, s2, e2, width)
    low = F.col(start) - grow
    hit = (low <= e2) & (s2 <= F.col(end) + grow) & (F.col("__bin") == F.floor(F.greatest(low, s2) / width))
    return a.join(b, [*keys, "__bin"]).filter(hit).drop("__bin")


def points_in(points: DataFrame, regions: DataFrame, keys: list[str], at: str, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of points and the regions that hold them; a point needs one bin, so there are no repeats."""
    p = points.withColumn("__bin", F.floor(F.col(at) / width))
    r = _binned(regions, F.col(start), F.col(end), width)
    return p.join(r, [*keys, "__bin"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("__bin")


def only_own_hit(left: DataFrame, pool: DataFrame, keys: list[str], id_col: str, width: int) -> DataFrame:
    """Ids of left that overlap exactly one interval of pool."""
    hits = overlap_join(left, pool, keys, width)
    return hits.groupBy(id_col).agg(F.count("*").alias("n")).filter("n = 1").select(id_col)


def signal_summary(track: DataFrame, regions: DataFrame, keys: list[str], name: str, width: int) -> DataFrame:
    """Per region: size, covered, sum, mean0 (over size), mean (over covered), min, max of a track(start, end, value)."""
    hit = overlap_join(regions, track, keys, width)
    span = F.least("end", "end_2") - F.greatest("start", "start_2") + 1
    got = hit.groupBy(name).agg(F.sum(span).alias("covered"), F.sum(span * F.col("value_2")).alias("sum"), F.min("value_2").alias("min"), F.max("value_2").alias("max"))
    out = regions.select(name, (F.col("end") - F.col("start") + 1).alias("size")).join(got, name, "left")
    out = out.fillna({"covered": 0, "sum": 0.0})
    return out.select(name, "size", "covered", "sum", F.try_divide("sum", "size").alias("mean0"), F.try_divide("sum", "covered").alias("mean"), "min", "max")


def width_of(start: Column, end: Column) -> Column:
    return end - start + 1


def flanks(strand: Column, left_start: Column, left_end: Column, right_start: Column, right_end: Column) -> tuple[Column, ...]:
    """Upstream start and end, downstream start and end of a strand's flanks to the left and to the right."""
    plus = strand == "+"
    pick = lambda a, b: F.when(plus, a).otherwise(b)
    return pick(left_start, right_start), pick(left_end, right_end), pick(right_start, left_start), pick(right_end, left_end)


def five_prime_window(strand: Column, start: Column, end: Column, up: int, down: int) -> tuple[Column, Column]:
    """The window of up places before and down places from the 5' end on, along the strand."""
    plus = strand == "+"
    return F.when(plus, start - up).otherwise(end - down + 1), F.when(plus, start + down - 1).otherwise(end + up)
