"""Registration of queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stratawell.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers f(t), t being a reader of tables by name, as a query (spark, sf_dir) under its own name."""

    def put(f):
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(lambda n: table(spark, sf_dir, n))

        key = name or f.__name__
        run.__name__, run.__doc__ = key, f.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return f

    return put


def r(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)
