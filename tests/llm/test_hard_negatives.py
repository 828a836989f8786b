"""Mined negatives against plain loops over all rows."""

import math
import random

import numpy as np
import pytest

from shopspark.llm.hard_negatives import PackedProducts, mined_report, hard_negatives, labelled_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, block string"


def brute_force(rows, every=100, shift=True):
    whole = {}
    for i, v, label in rows:
        if None not in (i, label) and v and all(x is not None and math.isfinite(256 * x) for x in v):
            whole[i] = min(whole.get(i, (label, v)), (label, v))
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    data = {i: (math.fmod(label + 1, 10) if shift and i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, (label, v) in whole.items()}
    out = []
    for a, (label, v) in data.items():
        if a % every:
            continue
        scored = sorted((-clamp(sum(x * y for x, y in zip(v, w))), i, other) for i, (other, w) in data.items() if i != a and len(w) == len(v))
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            fit = [(-s, i) for s, i, other in scored if other != label and 30 * -ps <= 100 * -s <= 90 * -ps]
            out += [(a, p, n + 1, i, -ps, s) for n, (s, i) in enumerate(fit[:10])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 0, "") for i, v, label in rows], SCHEMA).repartition(4)


def vectors(seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.uniform(-1, 1), 0.5, -0.015625]) for _ in range(6)], rng.randrange(10)) for i in range(900)]
    rows += [(i, [0.25] * 6, i % 3) for i in range(1000, 1120)]  # one vector many times
    rows += [(2000, None, 1), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2200, [float("nan")] * 6, 1), (2300, [float("inf")] * 6, 1), (2400, [], 1)]
    rows += [(2500, [1.0] * 6, None), (None, [1.0] * 6, 1), (100, [0.1] * 6, 0), (100, [0.1] * 6, 0), (200, [9.0] * 6, 3)]
    rows += [(3000, [1.0, 2.0], 1), (3001, [1.0, 1.0], 1), (3002, [0.5, 0.5], 2)]
    return rows


@pytest.mark.parametrize("sizes", [(64, 3), (8192, 512)])
def test_equals_all_products(spark, sizes):
    rows = vectors(2)
    moved = [(i, v, label) for i, v, label in rows]
    got = hard_negatives(labelled_vectors(table(spark, moved)), block_rows=sizes[0], anchor_rows=sizes[1]).collect()
    assert sorted(map(tuple, got)) == brute_force(rows, shift=False)


def test_report_moves_labels(spark):
    rows = vectors(5)
    assert sorted(map(tuple, mined_report(table(spark, rows)).collect())) == brute_force(rows)


def test_wide_values_and_empty_table(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 1e6 for _ in range(4)], i % 2) for i in range(60)]
    rows += [(100, [1e20, 1.0, 2.0, 3.0], 0), (101, [1e20, 0.0, 0.0, 0.0], 0), (102, [5e19, 1.0, 1.0, 1.0], 1), (104, [1e307] * 4, 1), (103, [-1e300, 0.0, 0.0, 0.0], 1)]
    df = labelled_vectors(table(spark, rows))
    assert sorted(map(tuple, hard_negatives(df).collect())) == brute_force(rows, shift=False)
    assert mined_report(table(spark, []).limit(0)).collect() == []


@pytest.mark.parametrize("top", [3, 200, 5000, 10**9, 10**25])
def test_packed_products_are_exact(top):
    rng = random.Random(top)
    make = lambda n: np.array([[float(rng.randint(-top, top)) for _ in range(16)] for _ in range(n)])
    anchors, candidates = make(5), make(33)
    packed = PackedProducts(anchors, candidates)
    assert packed.fields >= 2
    want = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, c)))) for c in candidates] for a in anchors]
    assert packed.scores(slice(0, 5)).tolist() == want
