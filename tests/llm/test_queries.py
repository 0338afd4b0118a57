"""The registered queries of the subpackage on the small tables."""

import pytest

import corpus_pipeline
from check import compare, connect
from nodeflow.llm.queries import ORACLES, QUERIES

ROWS = ("op5_simhash_near_dedup", "op6_token_counts", "op8_packing", "op9_token_binary", "op10_language_id", "op3_suffix_array_dedup", "op4_substring_dedup")


def test_each_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14)) and set(ORACLES) < set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name])[0] == ""


@pytest.mark.parametrize("name", ROWS)
def test_one_row_per_document(spark, sf, name):
    ids = [r["doc_id"] for r in QUERIES[name](spark, sf).select("doc_id").collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema == docs.schema or [f.name for f in out.schema] == docs.columns, name
        assert 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
