"""Conversation trie against a plain walk over all prefixes."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from shopspark.llm.prefix_trie import conversation_trie, rollup

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node string"


def brute_force(rows):
    convs = {}
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append(((turn is not None, turn or 0, digest(role or "", text or "")), (role or "", text or "")))
    own = {c: [t for _, t in sorted(turns)] for c, turns in convs.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    out = []
    for node, inside in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(o[: len(m)] == m and len(o) == len(m) + 1 for o in members)]
        saved = sum((len(members[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in below if m)
        joined = ",".join(map(str, sorted(ends.get(node, []))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(inside), len(node), parent, len(inside), len(children), len(leaves), saved, hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in conversation_trie(df, **options).collect()), key=str)


def conversations(seed):
    rng = random.Random(seed)
    texts = ["", "a b", "a  b\tc", None, "hello"]
    rows = []
    for c in rng.sample(range(120), 45):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += [(0, t, "user", f"t{t % 2}") for t in range(40)]  # deep
    rows += [(200 + i, t, "user", "same") for i in range(12) for t in range(4)]  # copies
    rows += [(77, None, "user", "null turn"), (77, None, "user", "null turn"), (77, 3, "user", "z"), (77, 3, "user", "y")]
    rows += [(None, 0, "user", "nobody"), (-7, 0, "user", "a b"), (-20, 0, "user", "a b"), (-20, 1, "user", "c")]
    return rows


@pytest.mark.parametrize("component", [1 << 16, 7])
def test_equals_all_prefixes(spark, component):
    rows = conversations(3)
    assert result(spark, rows, component=component) == brute_force(rows)


def test_empty_table_and_long_text(spark):
    assert result(spark, []) == []
    rows = [(0, 0, "user", "w " * 200_000), (1, 0, "user", None)]
    assert result(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "broom"])
def test_rollup_of_shapes(shape):
    rng, n = np.random.default_rng(1), 400
    at = np.arange(n)
    parent = {
        "chain": at - 1,
        "star": np.where(at == 0, -1, 0),
        "random": np.array([-1 if i % 90 == 0 else rng.integers(i - i % 90, i) for i in range(n)]),
        "broom": np.where(at < 200, at - 1, 199),
    }[shape]
    depth = np.zeros(n, np.int64)
    for i in range(n):
        depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 5
    values = rng.integers(0, 1000, (n, 2))
    want = values.copy()
    for i in reversed(range(n)):
        if parent[i] >= 0:
            want[parent[i]] += want[i]
    order = rng.permutation(n)
    place = np.argsort(order)
    shuffled = np.where(parent[order] >= 0, place[parent[order]], -1)
    assert (rollup(shuffled, depth[order], values[order]) == want[order]).all()
