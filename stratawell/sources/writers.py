"""Writers for results at the edge; inside, tables are Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratawell.sources.readers import all_exist


def csv(df: DataFrame, path: str, compressed: bool = True) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if compressed else "none").csv(path)


def lines(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def matrix(df: DataFrame, id_col: str, columns: list[str], path: str) -> None:
    """A tab-separated matrix without the id column's name, in id order: its header in the folder "header", rows in "body".

    Joined as header then body parts they are one file; each is written by tasks.
    """
    spark = df.sparkSession
    spark.createDataFrame([("\t".join(columns),)], "value string").write.mode("overwrite").text(f"{path}/header")
    row = F.concat_ws("\t", F.col(id_col).cast("string"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")) for c in columns])
    df.orderBy(id_col).select(row.alias("value")).write.mode("overwrite").text(f"{path}/body")


def bed(regions: DataFrame, path: str) -> None:
    """regions(seqnames, start, end, name) as 0-based half-open BED."""
    row = F.concat_ws("\t", "seqnames", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), "name")
    regions.select(row.alias("value")).write.mode("overwrite").text(path)


def fasta(sequences: DataFrame, path: str, name: str = "name", sequence: str = "seq") -> None:
    """Records without ambiguous bases."""
    lines(sequences.filter(~F.col(sequence).contains("N")), F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(sequence)), path)


def model(fitted, path: str) -> None:
    """A fitted Spark ML model or pipeline; readers.model brings it back."""
    fitted.write().overwrite().save(path)


def remembered(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; made and written first if it is not there or not complete."""
    if all_exist(spark, [f"{path}/_SUCCESS"]):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
