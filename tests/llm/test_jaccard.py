"""The similarity join against all pairs."""

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from shopspark.llm import jaccard
from shopspark.llm.jaccard import keep_one_of_each_group, similar_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIDDLE = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, run int, class string"


def shingle_set(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(text)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_force(docs):
    """docs: (id, text). The same rows from an inverted index over all shingles."""
    sets = [(i, shingle_set(t)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = defaultdict(list)
    for at, (_, s) in enumerate(sets):
        for x in s:
            index[x].append(at)
    for at, (i, s) in enumerate(sets):
        shared = Counter(o for x in s for o in index[x] if o < at)
        for o, both in shared.items():
            j, r = sets[o]
            if 100 * both >= 75 * (len(s) + len(r) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted((i, len(s), root(i)) for i, s in sets)


def found(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def test_equals_brute_force_on_the_table(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    assert found(similar_groups(docs)) == brute_force([(r.doc_id, r.text) for r in docs.collect()])


def test_edits_around_the_threshold(spark):
    rng = random.Random(5)
    docs, at = [], 0
    passage = [f"p{i}" for i in range(60)]
    for family in range(40):
        size = rng.choice([1, 2, 3, 5, 6, 7, 8, 9, 12, 20, 60, 63, 64, 70, 200, 510, 515])
        base = [f"w{rng.randrange(4000)}" for _ in range(size)]
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + size // 25 + 1)):
                spot = rng.randrange(len(words))
                words[spot : spot + 1] = rng.choice([[], ["x%d" % rng.randrange(99)], [words[spot], "y"]]) or ["z"]
            if family % 3 == 0:
                words += passage
            docs.append((at, " ".join(words)))
            at += 1
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], SCHEMA).repartition(5)
    assert found(similar_groups(df)) == brute_force(docs)


def test_a_chain_is_one_component(spark):
    words = [f"w{i}" for i in range(400)]
    docs = [(100 - k, " ".join(words[8 * k : 8 * k + 80])) for k in range(30)]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], SCHEMA).repartition(6)
    assert found(similar_groups(df)) == brute_force(docs)
    assert len({c for *_, c in found(similar_groups(df))}) == 1


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "long " * 60_000)]
    df = spark.createDataFrame([(i, t, 0, None) for i, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in similar_groups(df).collect()), key=str)
    assert got == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 2, 5), (5, 2, 5), (None, 2, None), (7, 1, 7)], key=str
    )
    kept = keep_one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 5, 7, None]
    assert similar_groups(df.limit(0)).collect() == []


def test_documents_and_ties_are_dealt_over_the_buckets(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = spark.range(4000).select("id", F.concat(F.lit(passage + " "), F.col("id").cast("string")).alias("text")).repartition(40)
    packed = rows.mapInArrow(jaccard._scan(jaccard.Sketch(), 5, 64), jaccard.PACKED_DDL)
    held = packed.groupBy("kind", "bucket").agg((F.sum(F.length("a")) / 8).alias("n")).collect()
    for kind in (jaccard.DOC, jaccard.TIE):
        sizes = [r.n for r in held if r.kind == kind]
        assert sum(sizes) >= 3900 and max(sizes) < sum(sizes) / 4


def test_shingles_between_components(spark):
    rng = random.Random(2)
    sets = [(i, rng.choice([0, 0, 1, 2]), rng.sample(range(-40, 40), rng.choice([3, 20, 21, 30]))) for i in range(60)]
    sets += [(100 + i, 3, [1000, 1001, *range(2000, 2018)]) for i in range(300)] + [(900, 4, [1000])]
    want, held = set(), defaultdict(list)
    level = lambda n: math.floor(math.log(n) / math.log(jaccard.CLASS))
    for i, label, values in sets:
        for v in values:
            held[v].append((i, label, len(values)))
    for v, owners in held.items():
        for i, label, n in owners:
            steps = {level(m) - level(n) + jaccard.REACH for _, o, m in owners if o != label}
            if steps:
                want.add((v, len(owners), i, label, n, level(n), sum(1 << k for k in steps if 0 <= k <= 2 * jaccard.REACH)))
    df = spark.createDataFrame(sets, "id long, label long, hashes array<long>").repartition(5)
    got = jaccard._between(df)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_outliers_of_a_large_group_do_not_meet_its_members(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]

    def edited(edits):
        words = list(base)
        for spot in rng.sample(range(0, 150, 6), edits):
            words[spot] = f"x{rng.randrange(10**6)}"
        return words

    sets = [edited(1 + k % 2) for k in range(120)] + [edited(rng.choice([5, 6])) for _ in range(60)]
    # Copies of outliers, and cuts of the text that are linked with each other but not with the whole.
    sets += [[*sets[130][:-1], "end"], [*sets[140][:-1], "end"], base[:100], base[2:100], base[:88], base[70:]]
    docs = [(i, " ".join(words)) for i, words in enumerate(sets)]
    counts, formed = [], jaccard._candidates

    def counted(*args):
        pairs = formed(*args)
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "_candidates", counted)
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], SCHEMA).repartition(6)
    want = brute_force(docs)
    assert found(similar_groups(df)) == want
    apart = len({c for *_, c in want})
    assert apart > 20 and sum(counts) < apart * len(docs) / 4


def links_by_hand(docs):
    """Pairs of different labels that reach the threshold, from every pair."""
    return {
        (a, b)
        for a, (la, sa) in docs.items()
        for b, (lb, sb) in docs.items()
        if a < b and la != lb and 100 * len(sa & sb) >= 75 * len(sa | sb)
    }


def test_candidates_hold_every_link_whatever_the_hubs(spark):
    rng = random.Random(3)
    docs = {}
    for family in range(6):
        base = [1000 * family + x for x in range(rng.choice([12, 30, 60]))]
        for _ in range(12):
            own = set(rng.sample(base, len(base) - rng.randrange(0, len(base) // 4)))
            own |= {rng.randrange(10**6, 10**6 + 400) for _ in range(rng.randrange(0, len(base) // 5))}
            docs[len(docs)] = (len(docs) % 40, own)
    level = lambda n: math.floor(math.log(n) / math.log(jaccard.CLASS))
    owners = Counter(x for _, s in docs.values() for x in s)
    least = lambda n, k: math.ceil((n + max(math.floor(jaccard.CLASS ** (level(n) + k - jaccard.REACH)) - 1, math.ceil(n * 0.75) - 1)) * 75 / 175 - 1e-6)
    full = (1 << 2 * jaccard.REACH + 1) - 1
    rows = [(x, owners[x], i, label, len(s), level(len(s)), full, least(len(s), 0)) for i, (label, s) in docs.items() for x in s]
    rows = spark.createDataFrame(rows, "print long, owners long, id long, label long, n long, class long, open long, need long")
    sets = spark.createDataFrame([(i, len(s), list(s)) for i, (_, s) in docs.items()], "id long, n long, hashes array<long>")
    want = links_by_hand(docs)
    assert len(want) > 30
    for choose in (lambda i: i - i % 12, lambda i: i, lambda i: rng.randrange(len(docs))):
        hubs = spark.createDataFrame([(i, choose(i)) for i in docs], "id long, hub long")
        got = {(r.a, r.b) for r in jaccard._candidates(rows, hubs, sets, 75).collect()}
        assert want <= got and all(docs[a][0] != docs[b][0] for a, b in got)
