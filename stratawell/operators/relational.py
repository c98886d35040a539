"""Joins, filters, sets and numbering with explicit rules for missing values and repeated keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def update_join(left: DataFrame, right: DataFrame, on: list[str] | dict[str, str], columns: list[str], order: Column | None = None) -> DataFrame:
    """left with columns overwritten from the matching row of right; without a match they stay, or are NULL if new.

    A match overwrites also with NULL.  right must have unique keys, unless order says which row of a
    key counts (the last).
    """
    keys = {k: k for k in on} if isinstance(on, list) else on
    if order is not None:
        last = W.partitionBy(*keys.values()).orderBy(order.desc())
        right = right.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")
    r = right.select(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(keys.values())], *[F.col(c).alias(f"__v_{c}") for c in columns], F.lit(True).alias("__hit"))
    same = reduce(lambda a, b: a & b, [left[a] == r[f"__k{i}"] for i, a in enumerate(keys)])
    out = left.join(r, same, "left")
    rest = [c for c in left.columns if c not in columns]
    new = [F.when(F.col("__hit"), F.col(f"__v_{c}")).otherwise(left[c] if c in left.columns else F.lit(None)).alias(c) for c in columns]
    return out.select(*[left[c] for c in rest], *new)


def not_in(df: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """Rows whose value is not among members' first column; a missing value is not a member."""
    m = members.select(F.col(members.columns[0]).alias("__m")).distinct()
    return df.join(m, df[column] == m["__m"], "left_anti")


def is_in(df: DataFrame, column: str, members: DataFrame) -> DataFrame:
    m = members.select(F.col(members.columns[0]).alias("__m")).distinct()
    return df.join(m, df[column] == m["__m"], "left_semi")


def first_where(*pairs: tuple[Column, Column]) -> Column:
    """The value of the first true condition."""
    out = F.when(*pairs[0])
    for c, v in pairs[1:]:
        out = out.when(c, v)
    return out


def filled(x: Column, other: Column) -> Column:
    """other where x is empty or missing."""
    return F.when(x.isNull() | (x == ""), other).otherwise(x)


def top_by(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; order must break ties."""
    w = W.partitionBy(*keys).orderBy(*order) if keys else W.orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def distinct_first(df: DataFrame, keys: list[str], columns: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n distinct column combinations of each key."""
    return top_by(df.select(*keys, *columns).distinct(), keys, order, n)


def row_ids(df: DataFrame, order: list[Column], name: str = "row_id") -> DataFrame:
    """Numbers from 1 in a stable order, without a single-task sort.

    Range partitions are numbered inside and shifted by the sizes before them; they are written once,
    so both steps see the same ranges.
    """
    from stratawell.session import stash

    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = stash(df.repartitionByRange(int(parts), *order).withColumn("__p", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__c"))
    shift = sizes.select("__p", (F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__c")).alias("__s"))
    inside = ranged.withColumn("__i", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    return inside.join(shift, "__p").withColumn(name, F.col("__s") + F.col("__i")).drop("__p", "__s", "__i")


def occurs_once(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs exactly once."""
    once = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n = 1").drop("__n")
    return df.join(once, keys, "left_semi")


def groups_where(df: DataFrame, keys: list[str], having: Column) -> DataFrame:
    """Rows of the groups that meet an aggregate condition."""
    good = df.groupBy(*keys).agg(having.alias("__ok")).filter("__ok").select(*keys)
    return df.join(good, keys, "left_semi")


def disjoint(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many distinct combinations a and b share, and whether they share none."""
    both = a.select(*columns).intersect(b.select(*columns))
    return both.agg(F.count("*").alias("n_shared")).withColumn("disjoint", F.col("n_shared") == 0)


def with_place(df: DataFrame, column: str, order: list[str], name: str = "place") -> DataFrame:
    """The place (from 1) of column's value in a fixed list of categories; values off the list come after it, NULL last."""
    places = F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i + 1)])
    listed = F.coalesce(F.try_element_at(places, F.col(column)), F.lit(len(order) + 1))
    return df.withColumn(name, F.when(F.col(column).isNull(), len(order) + 2).otherwise(listed))


def seeded_order(seed: int, *keys: str) -> Column:
    """A pseudo-random order of rows that depends on seed and keys only, not on partitions."""
    return F.xxhash64(F.lit(seed), *keys)


def seeded_sample(df: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(seeded_order(seed, *keys), *keys).limit(n)


def permuted(df: DataFrame, group: list[str], column: str, keys: list[str], seed: int, name: str) -> DataFrame:
    """column dealt to the rows of its group in pseudo-random order, as name."""
    a = W.partitionBy(*group).orderBy(*keys)
    b = W.partitionBy(*group).orderBy(seeded_order(seed, *keys), *keys)
    left = df.withColumn("__n", F.row_number().over(a))
    right = df.select(*group, F.col(column).alias(name), F.row_number().over(b).alias("__n"))
    return left.join(right, [*group, "__n"]).drop("__n")


def prefix_lookup(df: DataFrame, column: str, table: list[tuple[str, str]], name: str) -> DataFrame:
    """The value of the last key in table with which column starts, NULL if none; table is a short list."""
    value = F.lit(None).cast("string")
    for key, v in table:
        value = F.when(F.col(column).startswith(key), F.lit(v)).otherwise(value)
    return df.withColumn(name, value)


def stacked(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """Rows of all parts by column name with a source column; columns a part lacks are NULL."""
    frames = [df.withColumn(name, F.lit(k)) for k, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
