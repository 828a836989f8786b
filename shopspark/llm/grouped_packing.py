"""Best-fit packing by linear grouping.

Documents become pieces of at most ``SEQUENCE`` tokens, and a sequence holds any pieces
that fit. Lengths are whole numbers up to ``SEQUENCE``, so what has to be decided is
decided on counts of lengths, at most ``SEQUENCE`` of them however large the table is:

1. Large pieces, in the order of length, are cut into groups of equal cardinality and
   rounded up to the longest of their group: a few sizes.
2. How often to use which configuration of those sizes is a linear programme, solved by
   column generation: the simplex method, priced by a knapsack over the sequence's
   length. Whole numbers of sequences are filled; what the fractions leave over goes on
   with the small pieces.
3. The actual pieces take the places of their group by their rank. A place is worked
   out from the rank alone, so every piece finds its sequence by itself.
4. What rounding left free is counted by sequences, and the small pieces, longest
   first, go to the sequence with the least sufficient room. This too runs over counts:
   sequences with equal room are a range of ranks, and so are pieces of equal length.

Ranks come from counts by (task, length) and numbering within them, so no sort passes
through one task. Pieces of one sequence meet once, to get their offsets; a sequence
has at most ``SEQUENCE`` of them.

Only longer documents are cut: the first piece takes what is over a multiple of
``SEQUENCE``, the others are full.

Defined cases: a null text is empty; an empty document is its closing token. Repeated
rows and rows without identifier are packed as often as they stand in the table. Text
that is an added token becomes its id unless ``encode_special_tokens`` is set. An empty
table gives no pieces. Other columns are not looked at.
"""

from __future__ import annotations

import sys
import zlib
from types import ModuleType

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopspark.llm.textbytes import chunks
from shopspark.llm.token_ids import TokenIds
from shopspark.storage import materialize, spread

SEQUENCE = 2048
CLOSING = 0
#: Pieces longer than this are large; at most two of them share a sequence.
SMALL = SEQUENCE // 3
GROUPS = 128
ROUNDS = 2000

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- pieces --------------------------------------------------------------------------------------


def worker_encoder(path: str, encode_special_tokens: bool) -> TokenIds:
    """The encoder of this Python worker."""
    home = sys.modules.setdefault("shopspark_worker_token_ids", ModuleType("shopspark_worker_token_ids"))
    key = path, encode_special_tokens
    if key not in home.__dict__:
        home.__dict__[key] = TokenIds(*key)
    return home.__dict__[key]


def _cut(path: str, closing: int, encode_special_tokens: bool):
    def cut(batches):
        encoder = worker_encoder(path, encode_special_tokens)
        end = np.array([closing], "<u4")
        for batch in batches:
            for part in chunks(batch, "text"):
                out = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = np.concatenate([encoder(text.as_py() or ""), end])
                    start, to = 0, len(ids) % SEQUENCE or SEQUENCE
                    number = 0
                    while start < len(ids):
                        out.append((doc, number, start, to - start, zlib.crc32(ids[start:to].tobytes())))
                        start, to, number = to, to + SEQUENCE, number + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECES)], schema=PIECES)

    return cut


def document_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", closing: int = CLOSING,
    encode_special_tokens: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all documents."""
    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(_cut(tokenizer_path, closing, encode_special_tokens), PIECES_DDL)


# --- plans over counts ---------------------------------------------------------------------------


def best_configuration(sizes: np.ndarray, prices: np.ndarray, room: int = SEQUENCE) -> tuple[float, np.ndarray]:
    """The dearest choice of sizes, each as often as wanted, that fits into ``room``."""
    value = np.zeros(room + 1)
    rest = np.arange(room + 1)[None, :] - sizes[:, None]
    fits, rest = rest >= 0, np.maximum(rest, 0)
    picks = []
    for _ in range(room // int(sizes.min())):  # one more piece a round
        gains = np.where(fits, value[rest] + prices[:, None], 0.0)
        best = gains.argmax(axis=0)
        more = gains[best, np.arange(room + 1)]
        better = more > value + 1e-12
        if not better.any():
            break
        picks.append(np.where(better, best, -1))
        value = np.where(better, more, value)
    counts = np.zeros(len(sizes), np.int64)
    at = room
    for pick in reversed(picks):
        if pick[at] >= 0:
            counts[pick[at]] += 1
            at -= int(sizes[pick[at]])
    return float(value[room]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, room: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Fewest sequences that hold ``demand`` pieces of each size, fractions allowed.

    Gives the configurations (columns) and how often each is used. ``sizes`` are distinct.
    """
    n = len(sizes)
    columns = np.diag(room // sizes).astype(np.float64)
    amount = demand / np.diag(columns)
    for _ in range(ROUNDS):
        prices = np.linalg.solve(columns.T, np.ones(n))
        worth, entering = best_configuration(sizes, np.maximum(prices, 0.0), room)
        if worth <= 1 + 1e-7:
            break
        change = np.linalg.solve(columns, entering.astype(np.float64))
        usable = change > 1e-9
        ratio = np.full(n, np.inf)
        ratio[usable] = amount[usable] / change[usable]
        leaving = int(np.argmin(ratio))
        step = max(0.0, ratio[leaving])
        amount = np.maximum(amount - step * change, 0.0)
        columns[:, leaving], amount[leaving] = entering, step
    return columns.astype(np.int64), amount


class LargePlan:
    """Which sequence the large piece of a rank (by length, from the longest) belongs to."""

    def __init__(self, counts: np.ndarray, groups: int = GROUPS, small: int = SMALL, room: int = SEQUENCE):
        """``counts`` has the number of pieces by length, from 0 to ``room``."""
        self.small = small
        large = counts.copy()
        large[: small + 1] = 0
        total = int(large.sum())
        #: Rank of the first piece of each length.
        self.first = np.concatenate([np.cumsum(large[::-1])[::-1][1:], [0]])
        lengths = np.flatnonzero(large)[::-1]
        ends = np.cumsum(large[lengths])
        starts = np.unique([total * g // groups for g in range(groups)]) if total else np.empty(0, np.int64)
        sizes = lengths[np.searchsorted(ends, starts, "right")] if total else np.empty(0, np.int64)
        # Neighbouring groups of one rounded size are one size of the programme.
        head = np.concatenate([[True], sizes[1:] != sizes[:-1]]) if total else np.empty(0, bool)
        self.starts, self.sizes = starts[head], sizes[head]
        demand = np.diff(np.append(self.starts, total))
        self.sequences = 0
        #: Per group: rank in the group from which a run of sequences is filled, its first sequence, places in each.
        self.runs: list[list[tuple[int, int, int]]] = [[] for _ in demand]
        self.placed = np.zeros(len(demand), np.int64)
        if total:
            used, amount = configurations(self.sizes, demand.astype(np.float64), room)
            for config, times in sorted(zip(used.T.tolist(), np.floor(amount + 1e-6).astype(np.int64).tolist()), reverse=True):
                left = [(d - p) // c for d, p, c in zip(demand.tolist(), self.placed.tolist(), config) if c]
                times = min([times, *left])
                if times <= 0:
                    continue
                for g, places in enumerate(config):
                    if places:
                        self.runs[g].append((int(self.placed[g]), self.sequences, places))
                        self.placed[g] += places * times
                self.sequences += times

    def sequence(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Sequences of pieces given by length and rank within the length; -1 for those without a place."""
        out = np.full(len(length), -1)
        at = np.flatnonzero(length > self.small)
        if not len(at):
            return out
        overall = self.first[length[at]] + rank[at]
        group = np.searchsorted(self.starts, overall, "right") - 1
        inside = overall - self.starts[group]
        for g in np.unique(group).tolist():
            if not self.runs[g]:
                continue
            begin, sequence, places = (np.array(c) for c in zip(*self.runs[g]))
            mine = np.flatnonzero((group == g) & (inside < self.placed[g]))
            run = np.searchsorted(begin, inside[mine], "right") - 1
            out[at[mine]] = sequence[run] + (inside[mine] - begin[run]) // places[run]
        return out


class BestFit:
    """Best fit, longest first, of pieces by length into sequences by room; both are counts.

    Sequences are known by their rank: by room, then within it; new ones follow.
    """

    def __init__(self, pieces: np.ndarray, rooms: np.ndarray, room: int = SEQUENCE):
        """``pieces`` and ``rooms`` have numbers by length and by free tokens, from 0 to ``room``."""
        self.first_of_room = np.concatenate([[0], np.cumsum(rooms)[:-1]])
        self.old = int(rooms.sum())
        self.sequences = self.old
        free: list[list[tuple[int, int]]] = [[] for _ in range(room + 1)]
        for r in np.flatnonzero(rooms).tolist():
            free[r].append((int(self.first_of_room[r]), int(rooms[r])))
        #: Per length: rank from which a range of sequences is filled, its first sequence, pieces in each.
        self.runs: dict[int, list[tuple[int, int, int]]] = {}
        for length in np.flatnonzero(pieces[1:])[::-1].tolist():
            length += 1
            left, done, runs = int(pieces[length]), 0, []
            for r in range(length, room + 1):
                each = r // length
                while free[r] and left:
                    start, many = free[r].pop()
                    use = min(many, -(-left // each))
                    if use < many:
                        free[r].append((start + use, many - use))
                    full = min(use, left // each)
                    runs.append((done, start, each))
                    if full:
                        free[r - each * length].append((start, full))
                    if use > full:  # the last sequence takes fewer
                        free[r - (left - full * each) * length].append((start + full, 1))
                    took = min(left, use * each)
                    done, left = done + took, left - took
                if not left:
                    break
            if left:
                each = room // length
                use, full = -(-left // each), left // each
                runs.append((done, self.sequences, each))
                if full:
                    free[room - each * length].append((self.sequences, full))
                if use > full:
                    free[room - (left - full * each) * length].append((self.sequences + full, 1))
                self.sequences += use
            self.runs[length] = runs

    def sequence(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.empty(len(length), np.int64)
        for size in np.unique(length).tolist():
            begin, sequence, each = (np.array(c) for c in zip(*self.runs[size]))
            mine = np.flatnonzero(length == size)
            run = np.searchsorted(begin, rank[mine], "right") - 1
            out[mine] = sequence[run] + (rank[mine] - begin[run]) // each[run]
        return out


# --- the job -------------------------------------------------------------------------------------


def _ranked(rows: DataFrame, size: str, ties: list[str]) -> tuple[DataFrame, np.ndarray]:
    """``rows`` (with the task number ``part``) with their rank within ``size``, and the counts by size."""
    counts = materialize(rows.groupBy("part", size).agg(F.count("*").alias("n")), "grouped-counts")
    earlier = Window.partitionBy(size).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", size, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part", size).orderBy(*ties)) - 1
    ranked = rows.withColumn("rank", within).join(before, ["part", size]).withColumn("rank", F.col("rank") + F.col("before"))
    table = np.zeros(SEQUENCE + 1, np.int64)
    for row in counts.groupBy(size).agg(F.sum("n").alias("n")).collect():  # at most one row for each length
        table[row[size]] = row["n"]
    return ranked.drop("before"), table


def _assign(plan, size: str, schema: str):
    """Task function: add ``sequence`` by the plan, whose size does not follow the table."""

    def assign(frames):
        for frame in frames:
            frame["sequence"] = plan.sequence(frame[size].to_numpy(np.int64), frame["rank"].to_numpy(np.int64))
            yield frame

    return lambda rows: rows.mapInPandas(assign, schema)


def pack_pieces(pieces: DataFrame, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """``pieces`` (PIECES_DDL) with sequence_id and offset."""
    pieces = materialize(pieces.withColumn("part", F.spark_partition_id()), "grouped-pieces")
    ranked, counts = _ranked(pieces, "length", ["doc_id", "piece", "ids_crc32"])
    columns = f"{PIECES_DDL}, part int"
    large = LargePlan(counts, groups, small)
    ranked = ranked.select(*pieces.columns, "rank")
    dealt = materialize(_assign(large, "length", f"{columns}, rank long, sequence long")(ranked).drop("rank"), "grouped-large")

    filled = dealt.where("sequence >= 0").groupBy("sequence").agg((SEQUENCE - F.sum("length")).cast("int").alias("free"))
    filled = materialize(filled.withColumn("part", F.spark_partition_id()), "grouped-free")
    by_room, rooms = _ranked(filled, "free", ["sequence"])
    rest, small_counts = _ranked(dealt.where("sequence < 0").drop("sequence"), "length", ["doc_id", "piece", "ids_crc32"])
    fit = BestFit(small_counts, rooms)
    rest = _assign(fit, "length", f"{columns}, rank long, sequence long")(rest.select(*pieces.columns, "rank"))
    rest = rest.withColumnRenamed("sequence", "place")
    first = F.array(*[F.lit(int(n)) for n in fit.first_of_room])
    known = by_room.select(F.col("sequence").alias("sequence_id"), (F.get(first, F.col("free")) + F.col("rank")).alias("place"))
    # Places beyond the known sequences are new ones, numbered after them.
    fresh = F.col("place") - fit.old + large.sequences
    rest = rest.join(known, "place", "left").withColumn("sequence_id", F.coalesce("sequence_id", fresh))
    shown = [*PIECES.names, "sequence_id"]
    placed = dealt.where("sequence >= 0").withColumnRenamed("sequence", "sequence_id").select(*shown).unionByName(rest.select(*shown))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32")
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("offset", offset)


def pack_best_fit(docs: DataFrame, tokenizer_path: str, encode_special_tokens: bool = False, **plan: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document in few sequences."""
    return pack_pieces(document_pieces(docs, tokenizer_path, encode_special_tokens=encode_special_tokens), **plan)
