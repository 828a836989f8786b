"""Top-k search against all products."""

import math
import random

import pytest

from shopspark.llm.topk import exact_top_k

SCHEMA = "vec_id long, embedding array<double>, rank int, block string"


def brute_force(rows, k):
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in whole.items():
        if q % 20:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items() if i != q and len(a) == len(b))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(7, 3), (8192, 1024)])
def test_equals_all_products(spark, sizes):
    rng = random.Random(1)
    rows = [(i, [rng.choice([rng.uniform(-1, 1), 0.5, -0.015625]) for _ in range(5)]) for i in range(130)]
    rows += [(i, [0.25] * 5) for i in range(200, 260)]  # ties
    rows += [(300, None), (320, [1.0, None, 0.0, 0.0, 0.0]), (340, [float("nan")] * 5), (360, [float("inf")] * 5), (380, []), (None, [1.0] * 5)]
    rows += [(400, [1.0, 2.0]), (401, [3.0, -4.0]), (420, [1e7, -1e7, 1.0]), (421, [1e7, 1e7, 0.1]), (440, [9.0] * 7)]
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA).repartition(4)
    got = sorted(map(tuple, exact_top_k(df, block_rows=sizes[0], query_rows=sizes[1]).collect()))
    assert got == brute_force(rows, 20)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)
    assert [tuple(r) for r in exact_top_k(df).collect()] == [(0, 1, 1, 64 * 32)]
    assert exact_top_k(df.limit(0)).collect() == []


def test_scores_beyond_64_bits_count_as_the_nearest(spark):
    rows = [(0, [1e20, 1.0]), (1, [1e20, 0.0]), (2, [-1e20, 0.0]), (3, [2e20, 0.0]), (4, [0.0, 1.0]), (5, [1e307, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)
    top = 2**63 - 1
    assert [tuple(r) for r in exact_top_k(df).orderBy("rank").collect()] == [(0, 1, 1, top), (0, 2, 3, top), (0, 3, 4, 64 * 64), (0, 4, 2, -top)]
