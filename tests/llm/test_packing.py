"""Packing against direct tokenisation and an exhaustive search."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import AddedToken, Tokenizer

import corpus_pipeline
from shopspark.llm import packing
from shopspark.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def check(rows, texts, tokenizer):
    """texts: list of (id, text). Every id once, windows without gaps, ids equal to whole-text tokens."""
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    lengths = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.SEQUENCE
        lengths.append(at)
    for doc, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        mine = sorted(pieces[(doc, len(ids))], key=lambda r: r.start)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        covered = np.zeros(len(ids), int)
        for r in mine:
            covered[r.start : r.start + r.length] += 1
        assert covered.min() == covered.max()
    return sum(map(packing.padding, lengths)) / sum(lengths)


def test_the_table_is_packed_whole(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack_documents(docs, PATH, PATTERN).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in rows} == {d for d, _ in texts}
    assert check(rows, texts, tokenizer) < 0.01


def test_defined_cases(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "Nobody. Nothing."), (4, "word " * 30_000), (5, "x" * 20_000), (6, "<|endoftext|> it's\n\n  é ")]
    docs = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id long, text string, start int, length int")
    got = packing.pack_documents(docs.repartition(3), PATH, PATTERN).collect()
    check(got, rows, tokenizer)
    assert sum(r.length for r in got if r.doc_id == 3) == 4
    assert packing.pack_documents(docs.limit(0), PATH, PATTERN).collect() == []


def test_queries_encode_added_tokens(spark, tmp_path):
    default = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y  ", "<|endoftext| >", "no marker", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for rows in (QUERIES["op6_packing"](spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, "")):
        rows = rows.collect()
        assert [r.doc_tokens for r in rows if r.doc_id == 0] == [5]
        check(rows, list(enumerate(texts)), default)


@pytest.mark.parametrize("flags", [{}, {"lstrip": True}, {"rstrip": True}, {"single_word": True}])
def test_any_added_tokens(tmp_path, flags):
    made = Tokenizer.from_file(PATH)
    made.add_tokens([AddedToken("<x>", **flags), AddedToken("<x><y>", normalized=False)])
    made.save(f"{tmp_path}/more.json")
    for special in (False, True):
        made.encode_special_tokens = special
        encoder = packing.Encoder(f"{tmp_path}/more.json", PATTERN, special)
        for text in ("a <x> b", "a <x><y><x>b", "<|endoftext|> <x>\n<y>", "  ", "q<x>w  <x><x>"):
            assert encoder(text).tolist() == made.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    places = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 700, 40))]))
    if seed % 2:
        places = np.unique(np.concatenate([places, places[:20] + 1024, places[:20] + 2048]))
    penalty = rng.choice([0, 2, 48], len(places))
    best = [0.0] + [float("inf")] * (len(places) - 1)
    for i in range(1, len(places)):
        for j in range(i):
            length = int(places[i] - places[j])
            if length <= packing.SEQUENCE:
                pad = 0 if length in (packing.SEQUENCE, *packing.EXACT) else packing.SEQUENCE - length
                best[i] = min(best[i], best[j] + pad + penalty[i] + packing.WINDOW_COST)
    cuts = packing.best_cuts(places, penalty)
    at = dict(zip(places.tolist(), penalty.tolist()))
    total = 0
    for low, high in zip(cuts, cuts[1:]):
        length = high - low
        total += (0 if length in (packing.SEQUENCE, *packing.EXACT) else packing.SEQUENCE - length) + at[high] + packing.WINDOW_COST
    assert total == best[-1]


def test_blocks_give_one_stream():
    rng = np.random.default_rng(3)
    ends = np.zeros(100, bool)
    ends[:4] = True
    stream = packing.Stream(0, ends)
    pieces, sizes = [], rng.integers(1, 60_000, 12)
    for doc, size in enumerate(sizes):
        pieces += stream.add(doc, rng.integers(0, 100, size).astype("<u4"))
    pieces += stream.close()
    assert sum(p[2] for p in pieces) == sizes.sum()
    assert [p[0] for p in pieces] == sorted(p[0] for p in pieces)
    lengths = {}
    for p in pieces:
        assert lengths.get(p[5], 0) == p[6]
        lengths[p[5]] = p[6] + p[2]
    assert max(lengths.values()) <= packing.SEQUENCE
    assert sum(map(packing.padding, lengths.values())) / sizes.sum() < 0.02
