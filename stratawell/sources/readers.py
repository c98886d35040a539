"""Readers of measurement, annotation, interval and sequence files; all distributed, all with declared schemas."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratawell.functions.safe_math import clean
from stratawell.functions.text import hex_colour, keep_empty

SIGNAL = "name string, size bigint, covered bigint, sum double, mean0 double, mean double, min double, max double"
GTF = "seqnames string, source string, type string, start bigint, end bigint, score string, strand string, frame string, attributes string"


def delimited(spark: SparkSession, path: str | list[str], schema: str, sep: str = ",", header: bool = True, missing: str = "NA") -> DataFrame:
    """Delimited text, gzip too; ragged rows are filled.  Empty text stays "", the missing mark and NaN are NULL."""
    from pyspark.sql.types import StructType

    want = StructType.fromDDL(schema)
    raw = ", ".join(f"`{f.name}` string" for f in want)
    df = spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE").option("enforceSchema", True).schema(raw).csv(path)
    out = []
    for f in want:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind == "string":
            out.append(keep_empty(c, missing).alias(f.name))
        else:
            v = F.when(c != missing, c).try_cast(kind)
            out.append((clean(v) if kind in ("double", "float") else v).alias(f.name))
    return df.select(*out)


def selected(spark: SparkSession, path: str, columns: dict[str, str], sep: str = "\t") -> DataFrame:
    """The named columns of a headed file with their types, whatever else the file holds."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    return df.select(*[F.when(F.col(f"`{c}`") != "NA", F.col(f"`{c}`")).try_cast(t).alias(c) for c, t in columns.items()])


def header(spark: SparkSession, path: str, sep: str = "\t") -> list[str]:
    """Column names of a headed file: its first line alone is read."""
    first = spark.read.text(path).first()
    return first[0].split(sep) if first else []


def with_source(spark: SparkSession, paths: list[str], schema: str, pattern: str, name: str, sep: str = "\t", headed: bool = False) -> DataFrame:
    """Rows of many files with an id cut from each file's name by a pattern."""
    df = spark.read.option("header", headed).option("sep", sep).schema(schema).csv(paths)
    return df.withColumn(name, F.regexp_extract(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), pattern, 1))


def signal_summaries(spark: SparkSession, paths: list[str], pattern: str, name: str = "sample_id") -> DataFrame:
    """Headerless eight-column region summaries of many files."""
    return with_source(spark, paths, SIGNAL, pattern, name)


def gtf(spark: SparkSession, path: str, attributes: list[str], support: list[str] | None = None) -> DataFrame:
    """Annotation rows with the wanted attributes as columns; support keeps these transcript support levels."""
    df = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema(GTF).csv(path)
    pick = lambda a: F.nullif(F.regexp_extract("attributes", rf'(?:^|;)\s*{re.escape(a)} "?([^";]*)"?', 1), F.lit(""))
    if support:
        level = pick("transcript_support_level")
        df = df.filter(F.split(level, " ")[0].isin(*support))
    return df.select("seqnames", "type", "start", "end", "strand", *[pick(a).alias(a) for a in attributes])


def bed(spark: SparkSession, path: str) -> DataFrame:
    """Intervals (0-based half-open in the file, 1-based closed here), name as state."""
    df = spark.read.option("sep", "\t").option("comment", "#").schema("seqnames string, s bigint, end bigint, state string").csv(path)
    return df.select("seqnames", (F.col("s") + 1).alias("start"), "end", "state")


def indexed(states: DataFrame, prefix: str = "chromhmm") -> DataFrame:
    """states(seqnames, start, end, state) with name: the prefix and the row's place, from 1, in the order of the genome."""
    from stratawell.operators.relational import row_ids

    numbered = row_ids(states, [F.col(c) for c in ("seqnames", "start", "end", "state")], "__place")
    return numbered.withColumn("name", F.concat(F.lit(f"{prefix}_"), F.col("__place").cast("string"))).drop("__place")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name (first token of the header) and sequence of each record."""
    df = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head = F.regexp_extract("value", r"^(\S+)", 1)
    return df.select(head.alias("name"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("sequence"))


def sequence_chunks(sequences: DataFrame, size: int = 100_000, overlap: int = 100) -> DataFrame:
    """Long sequences in overlapping chunks: name, chunk, first (from 1) and piece, so no task holds many chromosomes."""
    n = F.greatest(F.ceil(F.length("sequence") / size), F.lit(1))
    parts = sequences.select("name", "sequence", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    first = F.col("chunk") * size + 1
    return parts.select("name", "chunk", first.alias("first"), F.substring("sequence", first.cast("int"), F.lit(size + overlap)).alias("piece"))


def subsequences(windows: DataFrame, chunks: DataFrame, size: int = 100_000) -> DataFrame:
    """windows(seqnames, start, end, strand, ...) with seq, reverse-complemented on the minus strand.

    A window of any length takes its part of every chunk that it meets; beyond the sequence's ends it is cut.
    """
    from stratawell.functions.text import reverse_complement

    w = windows.withColumn("__w", F.monotonically_increasing_id())
    w = w.withColumn("chunk", F.explode(F.sequence(F.floor((F.greatest("start", F.lit(1)) - 1) / size), F.floor((F.col("end") - 1) / size))))
    j = w.join(chunks.withColumnRenamed("name", "seqnames"), ["seqnames", "chunk"])
    a, z = F.greatest("start", "first"), F.least(F.col("end"), F.col("first") + size - 1)
    j = j.withColumn("__part", F.substring("piece", (a - F.col("first") + 1).cast("int"), (z - a + 1).cast("int")))
    whole = j.groupBy("__w", *windows.columns).agg(F.sort_array(F.collect_list(F.struct("chunk", "__part"))).alias("__parts"))
    s = F.array_join(F.col("__parts")["__part"], "")
    return whole.withColumn("seq", F.when(F.col("strand") == "-", reverse_complement(s)).otherwise(s)).drop("__w", "__parts")


def psi_matrix(spark: SparkSession, path: str) -> DataFrame:
    """event_id, sample_id and psi of a matrix whose header lacks the name of the first column."""
    names = header(spark, path)
    schema = "event_id string, " + ", ".join(f"`{n}` string" for n in names)
    df = spark.read.option("sep", "\t").option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    long = df.unpivot(["event_id"], [F.col(f"`{n}`") for n in names], "sample_id", "psi")
    return long.withColumn("psi", clean(F.when(F.col("psi") != "NA", F.col("psi")).try_cast("double")))


def event_members(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """event_id with its alternative and total transcript lists, and the event type of the file."""
    out = None
    for kind, path in paths.items():
        df = spark.read.option("sep", "\t").option("header", True).csv(path)
        df = df.select(F.lit(kind).alias("event_type"), "event_id", F.split("alternative_transcripts", ",").alias("alternative"), F.split("total_transcripts", ",").alias("total"))
        out = df if out is None else out.unionByName(df)
    return out.withColumn("other", F.array_except("total", "alternative"))


def scores(spark: SparkSession, path: str, ids: DataFrame, key: str = "sequence", name: str = "score") -> DataFrame:
    """ids(id, sequence) with the score that a file (sequence, score) gives the sequence."""
    df = spark.read.option("sep", "\t").schema("sequence string, score double").csv(path).dropDuplicates(["sequence"])
    return ids.join(df.select(F.col("sequence").alias(key), F.col("score").alias(name)), key, "left")


def methylation(spark: SparkSession, path: str) -> DataFrame:
    """position, sample_id and score of a position-by-sample matrix; -1 is no data."""
    names = header(spark, path, ",")
    df = spark.read.option("header", True).option("enforceSchema", True).schema("position bigint, " + ", ".join(f"`{n}` double" for n in names[1:])).csv(path)
    long = df.unpivot(["position"], [F.col(f"`{n}`") for n in names[1:]], "sample_id", "score")
    return long.filter("score <> -1")


def palette(spark: SparkSession, path: str) -> DataFrame:
    """section, label and hex colour of a JSON palette: section -> [{label: "r,g,b"}]."""
    text = spark.read.option("wholetext", True).text(path)
    parsed = F.from_json("value", "map<string, array<map<string, string>>>")
    flat = text.select(F.explode(parsed).alias("section", "parts")).select("section", F.explode("parts").alias("part"))
    return flat.select("section", F.explode("part").alias("label", "rgb")).select("section", "label", hex_colour(F.col("rgb")).alias("hex"))


def model(path: str):
    """A pipeline model that writers.model saved."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def all_exist(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that are missing, on whatever store they are."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        if not where.getFileSystem(conf).exists(where):
            out.append(p)
    return out
