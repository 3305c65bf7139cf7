"""Queries with SQL give its rows on the smallest tables; the others run over all of them."""

import pytest

from check import checking_engine, compare
from turnout.llm import queries

SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    problem = compare(queries.QUERIES[name](spark, SMALLEST), checking_engine(SMALLEST), queries.SQL[name])
    assert problem == ""


@pytest.mark.parametrize("name", ["op1_token_ids", "op4_quality_classifier", "op5_simhash_near_duplicates",
                                  "op6_toxicity", "op8_source_mixing"])
def test_a_row_for_each_document(spark, name):
    ids = sorted(r.doc_id for r in queries.QUERIES[name](spark, SMALLEST).select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{SMALLEST}/documents.parquet").select("doc_id").collect())


def test_a_row_for_each_page(spark):
    out = queries.QUERIES["op9_url_filter"](spark, SMALLEST)
    assert out.count() == spark.read.parquet(f"{SMALLEST}/pages.parquet").count()
    assert {r.verdict for r in out.select("verdict").distinct().collect()} == {"allow", "block"}
