"""Order-free comparison of a query with its SQL."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for n in TABLES:
        p = f"{folder}/{n}.parquet"
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, (float, np.floating)) and v != v:
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return repr(float(f"{float(v):.9g}"))
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(zip(*[[_cell(v) for v in df[c].astype(object)] for c in df.columns])) if len(df.columns) else []


def assert_equal(spark, query, sql, folder):
    got, want = query(spark, folder).toPandas(), connect(folder).execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
