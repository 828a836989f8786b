"""Targets and copies of the mix."""

from collections import Counter

from shopspark.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, draw int"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in docs], SCHEMA).repartition(3)


def water_fill(sizes, weights=(5, 2, 1), limit=3):
    """Reshare round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(order), sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total >= limit * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / total for s in free}
        for s in over:
            target[s] = limit * sizes[s]
        rest, free = rest - sum(target[s] for s in over), free - over
    return target


def test_targets_and_copies(spark):
    docs = [(i, "w " * (i * 37 % 90 + 1), ["b", "a", None, "é", "tiny", "Z"][min(i % 41 % 7, 5)]) for i in range(900)]
    docs += [(5000, "a b", "few"), (5001, None, "none"), (5002, "", "none")]
    rows = mixing.mix_report(frame(spark, docs)).collect()
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len((t or "").split())
    want, source = water_fill(sizes), {i: s for i, _, s in docs}
    taken = Counter()
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(rows) == len(docs)
    for s in sizes:
        if sizes[s] > 1000:
            assert abs(taken[s] - want[s]) < 0.02 * want[s]
    again = mixing.mix_report(frame(spark, docs).repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_the_mix_repeats_documents_as_reported(spark):
    docs = [(i, "w " * (i % 50), "abc"[i % 3]) for i in range(300)] + [(7, "same", "a")] * 2 + [(None, "x y", "b")]
    df = frame(spark, docs)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    copies = Counter((r.doc_id, r.text, r.source) for r in mixed.collect())
    stated = Counter()
    for r, t in ((r, r.size) for r in mixing.mix_report(df).where("size > 0").collect()):
        stated[r.doc_id] += r.taken // t
    counted = Counter()
    for (i, t, _), n in copies.items():
        counted[i] += n if t.split() else 0
    assert +counted == +stated


def test_empty_tables(spark):
    assert mixing.mix_report(frame(spark, []).limit(0)).collect() == []
    rows = mixing.mix_report(frame(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r.size, r.taken, r.target) for r in rows] == [(0, 0, 0.0)] * 2
