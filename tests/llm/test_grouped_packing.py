"""Best-fit packing: every id once, sequences never too long, and as few as a plain packing needs."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shopspark.llm.grouped_packing import SEQUENCE, BestFit, LargePlan, best_configuration, configurations, pack_best_fit
from shopspark.llm.token_ids import TokenIds

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length string, part int, sequence int"


def check_pieces(rows, texts):
    """Rows as dicts; ``texts`` by identifier, each identifier once."""
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        assert all(r.length == SEQUENCE for r in pieces[1:]) and pieces[0].length <= SEQUENCE
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= SEQUENCE
    return len(by_sequence)


def table(spark, texts):
    rows = [(doc, text, "x", 0, 0) for doc, text in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = pack_best_fit(docs, PATH).collect()
    tokens = sum(r.length for r in rows)
    assert check_pieces(rows, texts) <= -(-tokens // SEQUENCE) * 1.03 + 1


@pytest.mark.parametrize("plan", [{}, {"groups": 3, "small": 100}, {"groups": 2, "small": 2000}])
def test_special_cases(spark, plan):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice(["ab", "déjà", "x1", "\n", "...", "世界"]) for _ in range(rng.choice([1, 30, 400, 1500, 9000]))) for i in range(60)}
    texts |= {100: None, 101: "", 102: "a <|endoftext|> b", 103: "z" * 20_000, 104: " " * 9000 + "!", 105: "word " * 2046, 106: "word" + " word" * 2046}
    rows = pack_best_fit(table(spark, texts), PATH, **plan).collect()
    check_pieces(rows, texts)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, pack_best_fit(table(spark, texts), PATH, **plan).collect()))


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(7, "same text")] * 3 + [(None, "no id")] * 2, "doc_id long, text string")
    rows = pack_best_fit(df, PATH).collect()
    assert len(rows) == 5 and len({r.sequence_id for r in rows}) == 1
    at = 0
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == at
        at += r.length
    assert pack_best_fit(df.limit(0), PATH).collect() == []


def test_ids_equal_the_library(small, spark):
    library = Tokenizer.from_file(PATH)
    mine = TokenIds(PATH)
    texts = [r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    for text in [*texts, "it's I'LL we've", "\r\n\t  x", "0123456789" * 50, "a b　c", "<|endoftext|>", "é", "\U0001f600" * 9]:
        assert mine(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_configuration_is_the_dearest():
    rng = random.Random(3)
    for _ in range(30):
        sizes = np.array(rng.sample(range(3, 12), 4))
        prices = np.array([rng.random() for _ in sizes])
        worth, counts = best_configuration(sizes, prices, 20)
        best = [0.0] * 21
        for room in range(1, 21):
            best[room] = max([best[room - 1]] + [best[room - s] + p for s, p in zip(sizes.tolist(), prices.tolist()) if s <= room])
        assert worth == pytest.approx(best[20]) and counts @ sizes <= 20 and counts @ prices == pytest.approx(worth)


def test_programme_covers_demand():
    sizes, demand = np.array([1100, 900, 700, 690]), np.array([100.0, 100.0, 60.0, 30.0])
    columns, amount = configurations(sizes, demand)
    assert np.allclose(columns @ amount, demand) and (sizes @ columns <= SEQUENCE).all()
    assert amount.sum() == pytest.approx(145.0)  # two in each, never three


def test_plans_against_rooms():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, SEQUENCE + 1, 5000)
    counts = np.bincount(lengths, minlength=SEQUENCE + 1)
    length = np.repeat(np.arange(SEQUENCE + 1), counts)
    rank = np.concatenate([np.arange(n) for n in counts])
    large = LargePlan(counts)
    sequence = large.sequence(length, rank)
    fill = np.bincount(sequence[sequence >= 0], weights=length[sequence >= 0], minlength=large.sequences).astype(int)
    assert fill.max() <= SEQUENCE and fill.min() > 0
    rest = length[sequence < 0]
    rooms = np.bincount(SEQUENCE - fill, minlength=SEQUENCE + 1)
    few = np.bincount(rest, minlength=SEQUENCE + 1)
    fit = BestFit(few, rooms)
    place = fit.sequence(rest, np.concatenate([np.arange(n) for n in few]))
    free = np.concatenate([np.repeat(np.arange(SEQUENCE + 1), rooms), np.full(fit.sequences - fit.old, SEQUENCE)])
    assert (np.bincount(place, weights=rest, minlength=fit.sequences) <= free).all()
    halves = (lengths > SEQUENCE // 2).sum()
    assert fit.sequences <= max(halves, lengths.sum() / SEQUENCE) * 1.03
