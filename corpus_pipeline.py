"""Corpus preparation: quality, toxicity, near-duplicates, source mix, tokens.

Each stage is a function of (spark, docs, sf_dir); its result is written and
read again as the next stage's docs.  Stages read only the columns of
documents, whatever else a table holds, and take nulls, empty texts, ties,
repeated rows and empty tables as their operators' docstrings say; a rejected
document is one that the stage's classifier rejects, nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratawell.llm import bpe, minhash, mixing, quality_cnn, toxicity
from stratawell.session import stash, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
QUALITY_LEAST, TOXICITY_MOST = 0.5, 0.3
#: Words a tokenizing worker holds and text bytes it learns from at once; few, as workers and heaps have grown in the
#: stages before.
WORDS_HELD, BYTES_AT_ONCE = 150_000, 2 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least QUALITY_LEAST."""
    docs = docs.select(*COLUMNS)
    net = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    return quality_cnn.score_frame(docs, net, COLUMNS).filter(f"score >= {QUALITY_LEAST}").select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below TOXICITY_MOST."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_frame(docs, model, COLUMNS).filter(f"score < {TOXICITY_MOST}").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id."""
    return minhash.one_per_group(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and as far as the source mix takes them."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of each row."""
    return bpe.encode_frame(docs.select(*COLUMNS), with_ids=False, remember=WORDS_HELD, at_once=BYTES_AT_ONCE)


STAGES = [("quality", quality), ("toxicity", toxic), ("minhash", deduplicate), ("mixing", mix), ("bpe", tokens)]

#: The classifiers and the tokenizer are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
