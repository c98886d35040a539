"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratawell.session import ship


def remainder(modulus: int, id_col: str = "doc_id"):
    """crc32 of the id's text modulo modulus; -1 for rows without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, excluded: int, limit: int) -> DataFrame:
    """doc_id, text and label of at most limit labelled ids outside the excluded remainder.

    Ids come in the order of their hash, so the sample is the same on each run.
    Several labels of one id: the largest counts.  Rows without id or label are
    not used.
    """
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(modulus) != excluded))
    ids = ids.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # At most limit rows of 12 bytes: the broadcast is bounded.
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def fit_in_task(rows: DataFrame, train: Callable[[pa.Table | None], object]):
    """train(all rows as one table) in one executor task; only the model comes to the driver.

    rows has to be a bounded sample.  Without rows train gets None.
    """
    ship(rows.sparkSession)

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            model = pickle.dumps(train(pa.Table.from_batches(got)))
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    out = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(out[0].model) if out else train(None)
