"""What a task of the vector searches holds at once does not grow with queries, vectors or their width."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shopspark.operators import knn, vector_codes


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def blocks(queries: int, rows: int, width: int, **more) -> pd.DataFrame:
    rng = np.random.default_rng(3)
    asked = knn.unit(rng.normal(size=(queries, width)))
    data = knn.unit(rng.normal(size=(rows, width)))
    ids = {"ids": np.arange(rows).tobytes(), "query_ids": np.arange(queries).tobytes()}
    return pd.DataFrame([{**ids, "queries": asked.tobytes(), "data": data.tobytes(), **more}])


def test_scores_of_a_pack_are_held_in_slices():
    met, found = blocks(600, 16384, 64), []
    assert peak_mb(lambda: found.extend(knn._best_of_pack(10, True)(iter([met])))) < 40
    assert sum(map(len, found)) == 600 * 10


def test_tables_of_codes_are_held_in_slices():
    rng = np.random.default_rng(4)
    books = tuple(rng.normal(size=(256, 4)) for _ in range(16))
    met = blocks(2048, 50, 64, codes=rng.integers(0, 256, 50 * 16).astype(np.uint8).tobytes())
    assert peak_mb(lambda: sum(map(len, vector_codes._first_lists(books, 10, True)(iter([met]))))) < 20
    rows = rng.normal(size=(20_000, 4))
    assert peak_mb(lambda: vector_codes.nearest(rows, books[0])) < 20
    far = ((rows[:500, None, :] - books[0][None]) ** 2).sum(axis=2)
    assert (vector_codes.nearest(rows[:500], books[0]) == far.argmin(axis=1)).all()


@pytest.mark.parametrize("width", [64, 384])
def test_packs_are_bounded_by_bytes(spark, width):
    vector = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.sin(i * F.col("id")).cast("float"))
    corpus = spark.range(18_000).coalesce(1).select("id", vector.alias("v"), F.lit(0).alias("cell"))
    packs = knn.packs(corpus).select(F.length("ids") / 8, F.length("data")).collect()
    dealt, number = knn.numbered_packs(corpus)
    assert sum(n for n, _ in packs) == 18_000 and max(size for _, size in packs) <= 8 << 20
    assert number == -(-18_000 // (1_048_576 // width)) and dealt.agg(F.sum(F.length("ids")) / 8).first()[0] == 18_000


def test_python_batches_are_small(spark):
    """A worker holds a batch several times, a task has several workers, an executor several tasks."""
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20
