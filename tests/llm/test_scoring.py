"""The toxicity classifier and the quality sample."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopspark.llm import resampling, toxicity


def test_held_out_documents_are_told_apart(spark):
    rng = random.Random(2)
    syllables = ["ba", "do", "ki", "lu", "men", "tor", "sha"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(1200):
        words = [word() for _ in range(rng.randrange(5, 120))]
        bad = i % 8 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["grzx", "vyqw"]) + word()
        docs.append((i, " ".join(words), 1.0, "x"))
        labels.append((i, 1, int(bad)))
    docs += [(5000, None, 0.0, ""), (5001, "", 0.0, ""), (None, "grzxba", 0.0, ""), (5002, "ba " * 700_000, 0.0, "")]
    labels += [(None, 1, 1), (3, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double, toxic string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity_report(df, marks).collect()}
    assert len(rows) == len(docs)
    held = [r for i, r in rows.items() if r.held_out and i < 1200]
    assert 300 < len(held) < 500
    hits = [r.predicted for r in held if r.doc_id % 8 == 0]
    assert np.mean(hits) > 0.9 and not any(r.predicted for r in held if r.doc_id % 8)
    assert rows[5000].score == rows[5001].score < 0.7 and not rows[5002].predicted and not rows[None].held_out
    kept = toxicity.keep_clean(df, marks)
    assert kept.columns == df.columns
    gone = {i for i, r in rows.items() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == set(rows) - gone


def test_repeated_rows_of_a_labelled_identifier_are_learnt_once(spark):
    docs = [(i, "mild words here" if i % 2 else "grzx words here") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    copies = [(2, "grzx words here")] * 40 + [(3, "zz later text")] * 5
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    once, often = toxicity.fit(frame(docs), labels), toxicity.fit(frame(docs + copies), labels)
    assert np.array_equal(once.places, often.places) and np.allclose(once.weights, often.weights) and np.isclose(once.intercept, often.intercept)


def test_without_labels_nothing_is_toxic(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity_report(df, none).collect()} == {0.0}
    assert toxicity.toxicity_report(df.limit(0), none).collect() == []
    rows = resampling.importance_sample(df, none).collect()
    assert {r.log_weight for r in rows} == {0.0} and sum(r.kept for r in rows) == 2
    assert resampling.importance_sample(df.limit(0), none).collect() == []


def brute_weights(docs, good, effective):
    """Log-ratios with plain words instead of buckets; close to the hashed ones on few words."""
    from collections import Counter

    rows = [(i, (w := (t or "").lower().split()) + list(zip(w, w[1:]))) for i, t in docs]
    grams, raw, target = dict(rows), Counter(), Counter()
    for i, g in rows:
        raw.update(g)
        if i in good:
            target.update(g)
    n, m, b = sum(raw.values()), sum(target.values()), resampling.BUCKETS
    ratio = lambda x: np.log((target[x] + 1) / (m + b)) - np.log((raw[x] + 1) / (n + b))
    scale = lambda g: 1.0 if effective is None else effective / max(len(g), 1)
    return {i: float(sum(ratio(x) for x in g)) * scale(g) for i, g in grams.items()}


@pytest.mark.parametrize("effective", [None, 100])
def test_weights_and_sample(spark, effective):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["good", "fine", "well"] if i % 3 else ["bad", "worse"]) for _ in range(40))) for i in range(300)]
    docs += [(900, None), (901, ""), (None, "good fine"), (7, docs[7][1])]
    good = {i for i in range(100) if i % 3}
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, key int").repartition(3)
    marks = spark.createDataFrame([(i, int(i in good)) for i in range(100)] + [(None, 1)], "doc_id long, quality int")
    rows = resampling.importance_sample(df, marks, fraction=0.6, effective=effective).collect()
    want = brute_weights(docs, good, effective)
    for r in rows:
        assert abs(r.log_weight - want[r.doc_id]) < 1e-6
    keys = sorted((r.key for r in rows), reverse=True)
    cut = keys[round(0.6 * len(rows)) - 1]
    assert all(r.kept == (r.key >= cut) for r in rows)
    assert sum(r.kept for r in rows if r.doc_id and r.doc_id % 3 and r.doc_id < 300) > 150


def test_kth_largest(spark):
    rng = random.Random(9)
    values = [rng.choice([rng.gauss(0, 1), 1.0, -1e9, 1e-12]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 77, 250, 499, 500, 900):
        assert resampling.kth_largest(df, "v", k) == ordered[min(k, 500) - 1]
    assert resampling.kth_largest(df.limit(0), "v", 3) is None


def test_noise_is_gumbel(spark):
    noise = spark.range(4000).select(resampling.gumbel(F.col("id"), 1).alias("g")).toPandas()["g"]
    assert abs(noise.mean() - 0.5772) < 0.1 and abs(noise.std() - 1.2825) < 0.1


def plain_slots(text):
    """Places of all n-grams of a text, one at a time."""
    codes = [ord(c) for c in f" {text.lower()}" + "\0" * 5]
    factors = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)
    found = set()
    for size in toxicity.SIZES:
        for at in range(len(codes) - 5):
            h = sum(c * f for c, f in zip(codes[at : at + size], factors)) % 2**32
            h = (h ^ (h >> 15)) * 0x2C1B3C6D % 2**32
            h = (h ^ (h >> 13)) * 0x297A2D39 % 2**32
            found.add((size, h >> (32 - toxicity.BITS)))
    return {slot for _, slot in found}


def plain_scores(texts, labels):
    """texts: id -> text, labels: (id, 0 or 1). Scores of a model over a dense matrix, with counts in dictionaries."""
    from collections import Counter
    from math import log
    from zlib import crc32

    has = {i: plain_slots(t or "") for i, t in texts.items()}
    known = {i: int(y == 1) for i, y in labels if i in has and y is not None and crc32(str(i).encode()) % 3 != toxicity.HELD_OUT}
    n = Counter(known.values())
    seen = {0: Counter(), 1: Counter()}
    for i, y in known.items():
        seen[y].update(has[i])
    total = n[0] + n[1]

    def gain(slot):
        t, c = seen[1][slot], seen[0][slot]
        cells = [(t, t + c, n[1]), (c, t + c, n[0]), (n[1] - t, total - t - c, n[1]), (n[0] - c, total - t - c, n[0])]
        return 2 * sum(x * log(x * total / (side * whole)) for x, side, whole in cells if x)

    common = [s for s in seen[0] | seen[1] if seen[0][s] + seen[1][s] >= toxicity.LEAST_DOCS]
    # Equal gains may differ in the last digit; the order among them is by place.
    chosen = sorted(common, key=lambda s: (-round(gain(s), 9), s))[: toxicity.FEATURES]
    k = toxicity.SMOOTHING
    ratio = np.array([log((seen[1][s] + k) / (n[1] + 2 * k)) - log((seen[0][s] + k) / (n[0] + 2 * k)) for s in chosen])
    matrix = lambda ids: np.array([[s in has[i] for s in chosen] for i in ids], float) * ratio
    x, y = matrix(known), np.array(list(known.values()))
    balance = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    w, b = np.full(len(chosen), 0.1), -1.0
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, toxicity.STEPS + 1):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) * balance
        slope = np.append(x.T @ error + toxicity.PENALTY * w, error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = toxicity.RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    return dict(zip(has, 1 / (1 + np.exp(-(matrix(has) @ w + b)))))


def test_scores_equal_a_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = plain_scores(texts, [(r.doc_id, r.toxic) for r in labels.collect()])
    rows = toxicity.toxicity_report(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert abs(r.score - want[r.doc_id]) < 1e-4, r
        assert r.predicted == int(r.score >= toxicity.LIMIT)
