"""Thin wrappers that run a function on Arrow batches inside executors."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from stratawell.session import ship


def to_arrow_schema(ddl_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema as convert

    return convert(ddl_schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str, keeps_codec: bool = False) -> DataFrame:
    """Runs make() once per task, then the function it returns on each batch.

    The function yields dicts of equal-length columns, which become batches of
    the given schema.  Workers serve many stages: unless keeps_codec, what the
    tokenizer remembers in this one is released first.
    """
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    names = StructType.fromDDL(schema).names
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        if "stratawell.llm.bpe" in sys.modules and not keeps_codec:
            sys.modules["stratawell.llm.bpe"].release()
        work = make()
        for batch in batches:
            if batch.num_rows:
                for out in work(batch):
                    yield pa.RecordBatch.from_arrays([column(out[n], arrow.field(n).type) for n in names], schema=arrow)
        del work
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Gives memory that a worker has freed back to the machine; workers live on between tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)
