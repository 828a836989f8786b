import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopspark.functions.text import similarity, trigrams
from shopspark.functions.vector import cosine_distance
from shopspark.operators import knn
from shopspark.operators.embedding import HashedWords, embed
from shopspark.plans.search import ci_groups, ci_match, name_search, schema_search
from shopspark.sources.dictionary import data_dictionary
from shopspark.storage import scratch_path


def grams(text):
    out = set()
    for word in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        padded = f"  {word} "
        out |= {padded[i : i + 3] for i in range(len(padded) - 2)}
    return out


def test_trigrams_and_similarity(spark):
    pairs = [("word", "two words"), ("Ação", "acao"), ("", "x"), ("cat", "cat"), ("red-hat", "red hat")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("*", trigrams(F.col("a")).alias("g"), similarity(trigrams(F.col("a")), trigrams(F.col("b"))).alias("s")).collect():
        a, b = grams(r["a"]), grams(r["b"])
        assert set(r["g"]) == a
        assert r["s"] == pytest.approx(len(a & b) / len(a | b))


def test_name_search_finds_typos_and_parts(spark):
    df = spark.sql("select * from values (1,'Blue Jeans','Lee','Pants'),(2,'Shirt','Polo','Tops'),(3,'Jeanswear kit','X','Y') t(id,name,brand,category)")
    assert {r["id"] for r in name_search(df, "blu jeans").collect()} == {1}
    assert {r["id"] for r in name_search(df, "JEANS", threshold=0.99).collect()} == {1, 3}


def test_case_blind_match(spark):
    df = spark.sql("select * from values ('São Paulo'),('SÃO PAULO'),('Sao Paulo') t(city)")
    assert ci_match(df, "city", "são paulo").count() == 2
    assert sorted(map(tuple, ci_groups(df, "city").collect())) == [("sao paulo", 1), ("são paulo", 2)]


def test_embedding_takes_whole_texts_and_keeps_nulls(spark):
    long = "word " * 30_000 + "tail"
    df = spark.createDataFrame([(1, "red blue"), (2, None), (3, long), (4, "...")], "id bigint, text string")
    got = {r["id"]: r["embedding"] for r in embed(df, "text", batch_size=2).collect()}
    assert got[2] is None and len(got[1]) == 384
    assert np.linalg.norm(got[1]) == pytest.approx(1.0, abs=1e-6)
    assert got[3][HashedWords().cell("tail")] > 0 and not any(got[4])


def vectors(spark, n=300, width=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=width)]) for i in range(n)]
    rows += [(n, rows[0][1]), (n + 1, None)]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(5)


@pytest.mark.parametrize("block", [2048, 2])
def test_similar_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "QUERY_BLOCK", block)
    corpus = vectors(spark)
    queries = corpus.filter(F.col("id") < 5)
    got = {(r["query_id"], r["rank"]): r["id"] for r in knn.similar(corpus, queries, 4).collect()}
    data = {r["id"]: np.array(r["embedding"], dtype=float) for r in corpus.collect() if r["embedding"] is not None}
    for q in range(5):
        def far(i):
            return round(1 - data[i] @ data[q] / np.linalg.norm(data[i]) / np.linalg.norm(data[q]), 10)
        best = sorted(data, key=lambda i: (far(i), i))[:4]
        assert [got[q, r] for r in (1, 2, 3, 4)] == best


def test_similar_handles_fewer_rows_than_k_and_no_queries(spark):
    corpus = vectors(spark, n=2)
    assert knn.similar(corpus, corpus.filter("id = 0"), 10).count() == 3
    assert knn.similar(corpus, corpus.filter("id < 0"), 10).count() == 0
    # A null query vector asks nothing.
    assert knn.similar(corpus, corpus.filter("embedding is null"), 10).count() == 0


def test_cells_find_most_neighbours_and_all_with_all_cells(spark):
    corpus = vectors(spark, n=600).filter(F.col("embedding").isNotNull())
    queries = corpus.filter(F.col("id") < 20)
    exact = knn.similar(corpus, queries, 10)
    index = knn.build_index(corpus, scratch_path(spark, "cells"), cells=8)
    assert index.read(spark).count() == 601
    some = knn.recall(knn.similar_ann(index, queries, 10, probes=4), exact).first()["recall"]
    every = knn.recall(knn.similar_ann(index, queries, 10, probes=8), exact).first()["recall"]
    assert some >= 0.8 and every == 1.0


def test_cosine_distance_expression(spark):
    df = spark.sql("select array(1f, 0f) a, array(1f, 1f) b, array(0f, 0f) z")
    r = df.select(cosine_distance(F.col("a"), F.col("b")), cosine_distance(F.col("a"), F.col("z"))).first()
    assert r[0] == pytest.approx(1 - 2**-0.5) and r[1] is None


def test_dictionary_describes_every_column(spark):
    entries = data_dictionary(spark)
    assert entries.filter("table_name = 'orders' and column_name is not null").count() == 8
    assert entries.filter("comment is null or comment = ''").count() == 0
    best = schema_search(spark, "margin and stock age of a product", 3).collect()
    assert best[0]["rank"] == 1 and any("product" in r["table_name"] for r in best)
