"""The pipeline stage by stage against plain Python on each stage's own input."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from test_jaccard import brute_force
from test_mixing import water_fill
from test_packing import check
from test_scoring import plain_scores
from tokenizers import Tokenizer

import corpus_pipeline
from shopspark.llm import toxicity

STAGES = dict(corpus_pipeline.STAGES)
# Names that the stages use for columns of their own.
CLASHES = ["id", "key", "size", "rank", "draw", "copies", "target", "component_id", "keep_id", "print", "length", "start", "toxic", "doc"]


def widened(spark, small):
    """The documents with edge cases and with columns whose names the stages use too."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept, kinds = docs.columns, {f.name: f.dataType for f in docs.schema}
    odd = [(900_001, None, None), (900_002, "", "web"), (900_003, "two words", "tiny"), (900_004, "two words", "tiny"), (900_005, "word " * 20_000, None)]
    more = spark.createDataFrame(odd, "doc_id long, text string, source string")
    filled = [F.col(c).cast(kinds[c]) if c in more.columns else F.lit(None).cast(kinds[c]).alias(c) for c in kept]
    docs = docs.unionByName(more.select(*filled))
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES if c not in kept])


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_each_stage_equals_plain_python(spark, small):
    docs = widened(spark, small).cache()
    columns, marks = docs.columns, spark.read.parquet(f"{small}/labels.parquet")
    stage = lambda name, df: STAGES[name](spark, df, small).cache()

    before = texts_of(docs)
    scores = plain_scores(before, [(r.doc_id, r.toxic) for r in marks.collect()])
    assert min(abs(s - toxicity.LIMIT) for s in scores.values()) > 1e-7
    docs = stage("toxicity", docs)
    assert docs.columns == columns
    assert texts_of(docs) == {i: before[i] for i, s in scores.items() if s < toxicity.LIMIT}

    before, last = texts_of(docs), {}
    for i, text in before.items():
        last[text or ""] = max(i, last.get(text or "", i))
    docs = stage("exact_dedup", docs)
    assert docs.columns == columns and texts_of(docs) == {i: before[i] for i in last.values()}

    before = texts_of(docs)
    first = {component for _, _, component in brute_force(list(before.items()))}
    docs = stage("ngram_jaccard", docs)
    assert docs.columns == columns and texts_of(docs) == {i: before[i] for i in first}

    rows = [(r.doc_id, len((r.text or "").split()), r.source) for r in docs.collect()]
    want = plain_copies(rows)
    before, docs = {r.doc_id: r for r in docs.collect()}, stage("mixing", docs)
    mixed = docs.collect()
    assert docs.columns == columns and all(before[r.doc_id] == r for r in mixed)
    assert Counter(r.doc_id for r in mixed) == want

    pieces = stage("packing", docs).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {p.doc_id for p in pieces} == set(want)
    check(pieces, [(i, before[i].text) for i in want], tokenizer)
    heads = Counter(p.doc_id for p in pieces if p.start == 0)
    assert heads == want


def plain_copies(rows):
    """Copies of each document: whole rates, and one more by the draw nearest to the source's fraction."""
    sizes, held = Counter(), defaultdict(list)
    for i, size, source in rows:
        sizes[source] += size
        held[source].append((i, size))
    target, out = water_fill(sizes), Counter()
    for source, own in held.items():
        rate = target[source] / sizes[source] if sizes[source] else 0.0
        fraction = rate - int(rate)
        draws = [{i: int(hashlib.sha256(str(i).encode()).hexdigest()[8 * k : 8 * k + 8], 16) / 2**32 < fraction for i, _ in own} for k in range(8)]
        best = min(draws, key=lambda d: abs(sum(n for i, n in own if d[i]) - fraction * sizes[source]))
        for i, _ in own:
            if copies := int(rate) + best[i]:
                out[i] = copies
    return out
