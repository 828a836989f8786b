"""Order-preserving packing into sequences by dynamic programming.

Documents in the order of their identifiers form one stream of tokens for each
range of identifiers. A stream is cut into windows of at most ``SEQUENCE`` tokens.
A window costs its padding (none at full length or at a power of two), a small
fixed amount, and a penalty for where it ends: none at the end of a document,
little at the end of a sentence, more inside a sentence. The least total is found
over all cut points by a recurrence whose sliding minimum is kept in a monotone
queue. Streams are solved block by block: the windows near the end of a block go
into the next one, so a task holds one block and one document at a time, and its
memory does not follow the corpus. The last window of a range is cut into powers
of two where that saves padding.

Ranges come from Spark's range partitioning, which balances them by rows; every
range is packed by one task from rows sorted in it, so a lost task gives the same
pieces again.

Defined cases: a null text is empty; an empty document is its closing token. A
null identifier sorts first. Repeated rows are packed as often as they stand in
the table, each with pieces of its own. Very long texts are tokenised whole and
cut into as many windows as needed. Text that is an added token of the tokenizer
becomes its id, and the texts between are encoded by themselves; with
``encode_special_tokens``, special tokens are text like any other. An empty table
gives no pieces. Other columns are not looked at.
"""

from __future__ import annotations

import sys
import zlib
from collections import deque
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopspark.llm.textbytes import chunks
from shopspark.llm.token_ids import TokenIds

SEQUENCE = 2048
CLOSING = 1
BLOCK_TOKENS = 1 << 17
#: Costs in tokens.
WINDOW_COST = 4
SENTENCE_CUT = 2
HARD_CUT = 48
#: Inside a run without sentence ends, cut points every so many tokens.
HARD_STEP = 256
EXACT = (1024, 512)

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of texts, and which tokens end a sentence."""

    def __init__(self, path: str, pattern: str, encode_special_tokens: bool = True):
        self.ids = TokenIds(path, encode_special_tokens, pattern)
        vocabulary = self.ids.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, at in vocabulary.items():  # "Ċ" stands for a line end
            self.ends[at] = token.endswith((".", "!", "?")) or "Ċ" in token

    def __call__(self, text: str) -> np.ndarray:
        return self.ids(text)


def worker_encoder(path: str, pattern: str, encode_special_tokens: bool = True) -> Encoder:
    """The encoder of this Python worker; later tasks of the worker find it loaded."""
    home = sys.modules.setdefault("shopspark_worker_encoders", ModuleType("shopspark_worker_encoders"))
    key = path, pattern, encode_special_tokens
    if key not in home.__dict__:
        home.__dict__[key] = Encoder(*key)
    return home.__dict__[key]


def padding(length: int) -> int:
    return 0 if length & (length - 1) == 0 else SEQUENCE - length


def cut_points(ends: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a block may be cut, in order from 0 to its length, with the penalty of each.

    ``ends`` and ``closes`` mark the tokens that end a sentence or a document.
    """
    n = len(ends)
    soft = np.flatnonzero(ends | closes) + 1
    places = np.unique(np.concatenate([[0], soft, [n]]))
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > HARD_STEP)
    extra = [np.arange(places[i] + HARD_STEP, places[i + 1], HARD_STEP) for i in wide.tolist()]
    places = np.unique(np.concatenate([places, *extra])) if extra else places
    before = places - 1
    penalty = np.where(closes[before], 0, np.where(ends[before], SENTENCE_CUT, HARD_CUT))
    penalty[0] = 0
    return places, penalty


def best_cuts(places: np.ndarray, penalty: np.ndarray) -> list[int]:
    """The cut points of the cheapest windows from the first place to the last.

    With windows ending at x and starting at y the cost is best(y) + y plus what
    depends on x alone, so the best start within reach is a sliding minimum.
    """
    at, extra = places.tolist(), penalty.tolist()
    place_of = {p: i for i, p in enumerate(at)}
    cost = [0] * len(at)
    back = [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(at[0], 0)])
    for i in range(1, len(at)):
        x = at[i]
        while at[queue[0][1]] < x - SEQUENCE:
            queue.popleft()
        key, start = queue[0]
        least = key + SEQUENCE - x
        for size in (SEQUENCE, *EXACT):
            y = place_of.get(x - size)
            if y is not None and cost[y] < least:
                least, start = cost[y], y
        cost[i] = least + extra[i] + WINDOW_COST
        back[i] = start
        key = cost[i] + x
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i))
    cuts, i = [at[-1]], len(at) - 1
    while i:
        i = back[i]
        cuts.append(at[i])
    return cuts[::-1]


def tail_cuts(low: int, high: int) -> list[int]:
    """Inner cuts of a last window into powers of two, as far as they save padding."""
    cuts = []
    while padding(high - low) > HARD_CUT:
        low += 1 << ((high - low).bit_length() - 1)
        cuts.append(low)
    return cuts


class Stream:
    """One range of documents: takes token arrays in order, gives pieces."""

    def __init__(self, first_sequence: int, ends: np.ndarray):
        self.sequence, self.ends = first_sequence, ends
        self.parts: list[tuple] = []  # (doc, start, tokens of the document, ids)
        self.held = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        while start < len(ids):
            take = min(len(ids) - start, BLOCK_TOKENS)
            self.parts.append((doc, start, len(ids), ids[start : start + take]))
            self.held += take
            start += take
            if self.held >= BLOCK_TOKENS:
                yield from self._solve(last=False)

    def close(self) -> Iterator[tuple]:
        if self.held:
            yield from self._solve(last=True)

    def _solve(self, last: bool) -> Iterator[tuple]:
        stream = np.concatenate([p[3] for p in self.parts])
        closes = np.zeros(len(stream), bool)
        at = 0
        for _, start, total, ids in self.parts:
            at += len(ids)
            closes[at - 1] = start + len(ids) == total
        cuts = best_cuts(*cut_points(self.ends[stream], closes))
        if last:
            cuts[-1:] = [*tail_cuts(cuts[-2], cuts[-1]), cuts[-1]]
        else:
            cuts = cuts[: max(2, len(cuts) - 4)]
        yield from self._pieces(cuts)

    def _pieces(self, cuts: list[int]) -> Iterator[tuple]:
        """Pieces of the windows between ``cuts``; what follows the last cut is kept."""
        parts, at, window = deque(self.parts), 0, 1
        while window < len(cuts):
            doc, start, total, ids = parts.popleft()
            take = min(len(ids), cuts[window] - at)
            yield (doc, start, take, zlib.crc32(ids[:take].tobytes()), total, self.sequence, at - cuts[window - 1])
            at += take
            if take < len(ids):
                parts.appendleft((doc, start + take, total, ids[take:]))
            if at == cuts[window]:
                window += 1
                self.sequence += 1
        self.parts, self.held = list(parts), sum(len(p[3]) for p in parts)


def _pack(path: str, pattern: str, closing: int, encode_special_tokens: bool):
    """Task function: tokenise the rows of a sorted range and pack them."""

    def rows_of(pieces: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pieces), PIECES)], schema=PIECES)

    def pack(batches):
        encoder = worker_encoder(path, pattern, encode_special_tokens)
        stream = Stream(TaskContext.get().partitionId() << 32, encoder.ends)
        end = np.array([closing], "<u4")
        found: list[tuple] = []
        for batch in batches:
            for part in chunks(batch, "text"):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = np.concatenate([encoder(text.as_py() or ""), end])
                    found += stream.add(doc, ids)
                if len(found) > 10_000:
                    yield rows_of(found)
                    found = []
        found += stream.close()
        if found:
            yield rows_of(found)

    return pack


def pack_documents(
    docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", closing: int = CLOSING,
    encode_special_tokens: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer_path`` is a byte-level tokenizer file that every executor can read
    and ``pattern`` the expression by which it cuts texts into words. A text's ids are
    those of the tokenizer with that setting of ``encode_special_tokens``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranges = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    packed = ranges.mapInArrow(_pack(tokenizer_path, pattern, closing, encode_special_tokens), PIECES_DDL)
    return packed.withColumnRenamed("doc_id", id_col)
