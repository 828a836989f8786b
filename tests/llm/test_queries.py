"""The registered queries of the subpackage: SQL twins and the pipeline by its stages."""

import pytest

import __spark_entry__ as registry
import corpus_pipeline
from check import compare, oracle_connection
from shopspark.llm.queries import QUERIES, SQL


def test_all_are_registered():
    assert set(QUERIES) <= set(registry.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline"} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    assert compare(spark, oracle_connection(small), small, name) == ""


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    counts, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, small).cache()
        assert docs.columns == columns
        counts.append(docs.count())
        assert all(before[r.doc_id] == r.text for r in docs.collect()), name
    assert counts[0] > counts[1] > counts[2] > counts[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}
