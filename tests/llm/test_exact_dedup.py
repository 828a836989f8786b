"""Exact duplicates against a dictionary."""

import hashlib
from collections import defaultdict

import pytest

from shopspark.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

SCHEMA = "doc_id long, text string, run int, digest string"


def expected(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    return sorted(
        (i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in docs
    )


@pytest.mark.parametrize("runs,fan_in", [(2, 2), (7, 3), (256, 16)])
def test_equals_a_dictionary(spark, runs, fan_in):
    docs = [(i, ["", None, "a", "A", "a ", "é", "x" * 100_000, f"own {i}"][i * 7 % 8]) for i in range(400)]
    df = spark.createDataFrame([(i, t, 1, "d") for i, t in docs], SCHEMA).repartition(9)
    got = exact_duplicates(df, runs=runs, fan_in=fan_in)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == expected(docs)


def test_repeated_rows_and_null_identifiers(spark):
    rows = [(5, "a"), (5, "a"), (3, "a"), (None, "a"), (None, "b"), (None, "b"), (7, None), (7, "")]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA)
    got = exact_duplicates(df).collect()
    assert len(got) == 8
    by_text = defaultdict(list)
    for r in got:
        by_text[r.text_sha256].append(r)
    assert sorted(len(g) for g in by_text.values()) == [2, 2, 4]
    assert all(sum(r.kept for r in g) == 1 for g in by_text.values())
    kept = drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str) == [(5, "a"), (7, ""), (None, "b")]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(df).collect() == [] and drop_exact_duplicates(df).collect() == []


def test_plan_has_no_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "Window" not in plan
