"""The registered queries: against their SQL, and their contracts' columns."""

import zlib

import pytest

from stratawell.llm import queries
from tests.compare import assert_equal

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    assert_equal(spark, queries.QUERIES[name], queries.ORACLE[name], SF)


@pytest.mark.parametrize("name, modulus, out, least", [("op2_counterfactual", 4, 2, 0.3), ("op8_byte_cnn", 3, 1, 0.5)])
def test_classifier_queries(spark, name, modulus, out, least):
    ids = {x.doc_id for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    rows = queries.QUERIES[name](spark, SF).collect()
    assert {x.doc_id for x in rows} == ids and len(rows) == len(ids)
    for x in rows:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % modulus == out)
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= least)


def test_page_query(spark):
    rows = queries.QUERIES["op7_tree_model"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(x.n_chars == len(x.text) for x in rows)
