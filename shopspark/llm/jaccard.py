"""N-gram Jaccard join: documents chosen by parity sketches, pairs by shared shingles.

A document is the set of its distinct word shingles, each a 64-bit hash. The
sketch has one bit per hash value and a shingle flips its bit, so the Hamming
distance of two sketches is at most the symmetric difference of the sets. The
sketch is cut into parts by the hash's leading bits; a part is compared by a
fingerprint, the XOR of a hash of each of its set bits. Every differing shingle
spoils one part at most.

*Bound.* For sets of sizes a and b with similarity at least t the symmetric
difference is at most (1 - t) / (1 + t) * (a + b), hence at most d(a) =
(1 / t - 1) * a for any partner of a set of size a. A sketch with p non-empty
parts shares at least p - d of them with every partner. Ordered by fingerprint,
the first d + m parts of each of the two share at least m (the first m common
ones cannot lie behind more than d others). So a document emits d(a) + m(a) parts
with m growing with a, and a document that finds fewer than m of them elsewhere
has no partner. That keeps out documents which share a passage or a line only.

The parts choose the documents that can have a partner and give first links. No
Hamming distance is computed, and below 512 shingles a part is nearly always one
shingle. All other pairs come from a count of shared shingles with a prefix filter.

*Size bands.* The number of parts follows the size by bands, each ``BAND`` times
the one before. A document whose partners may be in the next band emits for that
band as well.

*Skew.* Equal sets and equal parts fold within each batch before anything is
shuffled: a batch sends one row of fingerprints per bucket and one owner for each
fingerprint. Fingerprints travel packed in buckets whose number follows the input,
so a bucket's memory does not grow with the corpus. Rows of documents and ties
found in a batch are cut into slices and dealt over all buckets. Owners of a fingerprint are
tied to its smallest owner only, never to each other. The best tie of each document
is verified exactly and gives first components. What those leave open is settled on
the shingles themselves: only shingles held by different components count, and a
document stays only if enough of its own are held by documents of one size class
(:data:`CLASS` apart) to reach the threshold with a partner of that size. The rest
is compared with the member of its group that shares most, its hub, and only between
the components still apart are pairs formed, by shared shingles: outside the hub; inside
it where both reach far enough into it for their exact sizes; and between hubs, each
document leaving out as many of its most frequent shingles as its overlap with any
partner allows. No link is lost: what two documents share inside a hub is at most what
either shares with it.

The chance that a set's parts collapse so far that the bound has no parts to work
with is below 1e-9 a document at these part counts; 64-bit hashes stand for
shingles.

Defined cases: null text is empty; a text without words has an empty set, is
linked with nothing and is its own component. A null identifier is linked with
nothing and has a null component. Rows with equal identifiers are one node. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopspark.llm.components import components
from shopspark.llm.textbytes import WordHasher, chunks, flat, mix, shingles
from shopspark.storage import materialize

BAND = 8
FLUSH_WORDS = 1_500_000
BUCKET_CHARS = 16_000_000
BUCKET_ROWS = 1_000_000
#: Rows of documents or ties that travel to one bucket together.
SLICE_ROWS = 4096
NO_ID = np.iinfo(np.int64).min
#: Size classes of the last step: ratio of neighbours, and how many on either side can hold partners.
CLASS, REACH = 1.02, 18
#: Times that only each document's likeliest pair is verified before all pairs left are.
BEST_ROUNDS = 3


class Sketch:
    """Bounds and fingerprints for a similarity of ``percent`` hundredths."""

    def __init__(self, percent: int = 75, margin: float = 0.25):
        self.percent, self.margin = percent, margin

    def spoiled(self, a: int) -> int:
        """Most differing shingles between a set of this size and a partner."""
        return a * (100 - self.percent) // self.percent

    def common(self, a: int) -> int:
        """Parts that two partners of at least this size share among those they emit."""
        return 1 + int(self.margin * a)

    def required(self, a: int) -> int:
        """Parts that a set of this size shares with any partner among those emitted."""
        return self.common(-(-a * self.percent // 100))

    def fingerprints(self, hashes: np.ndarray) -> np.ndarray:
        """What a set emits: fingerprints of its first parts, in each band it can meet a partner in."""
        a = len(hashes)
        band = 0
        while BAND ** (band + 1) <= a:
            band += 1
        bands = [band]
        if a * 100 // self.percent >= BAND ** (band + 1):
            bands.append(band + 1)
        out = []
        for at in bands:
            parts = np.uint64(max(1 << 20, 2 * BAND ** (at + 1)) if at < 3 else 2 * BAND ** (at + 1))
            place = ((hashes >> np.uint64(32)) * parts) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            content = np.bitwise_xor.reduceat(mix(hashes), first)
            prints = np.sort(mix(content + np.uint64(at + 1)))
            out.append(prints[: self.spoiled(a) + self.common(a)])
        return np.concatenate(out)


def _ties(prints: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For prints in order with owners rising within a print: first-of-run marks, and each row's first owner."""
    fresh = np.concatenate([[True], prints[1:] != prints[:-1]]) if len(prints) else np.empty(0, bool)
    heads = owners[fresh][np.cumsum(fresh) - 1] if len(prints) else owners
    sizes = np.diff(np.append(np.flatnonzero(fresh), len(prints)))
    return fresh, heads, np.repeat(sizes, sizes)


def _counted(owners: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, head) pairs with their number."""
    order = np.lexsort((heads, owners))
    owners, heads = owners[order], heads[order]
    if not len(owners):
        return owners, heads, np.empty(0, np.int64)
    fresh = np.flatnonzero(np.concatenate([[True], (owners[1:] != owners[:-1]) | (heads[1:] != heads[:-1])]))
    return owners[fresh], heads[fresh], np.diff(np.append(fresh, len(owners)))


PACKED = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
PACKED_DDL = "bucket long, kind int, a binary, b binary, c binary"
DOC, TIE, SAME, PRINT = 0, 1, 2, 3


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    data = [(b, k, *(x.tobytes() for x in cols), *[b""] * (3 - len(cols))) for b, k, *cols in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*data), PACKED)], schema=PACKED)


def _by_bucket(prints: np.ndarray, owners: np.ndarray, buckets: int, kind: int) -> Iterator[tuple]:
    """Sorted prints cut into buckets; the rest of the print travels as 32 bits."""
    top = ((prints >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.searchsorted(top, np.arange(buckets + 1, dtype=np.uint64))
    rest = mix(prints).astype(np.uint32)
    for b in range(buckets):
        low, high = cuts[b], cuts[b + 1]
        if high > low:
            yield (b, kind, owners[low:high], rest[low:high])


def _spots(buckets: int) -> Iterator[int]:
    """Buckets in an order of its own for each task, the same when the task is repeated."""
    at = TaskContext.get().partitionId() << 32
    while True:
        yield int(mix(np.array([at], np.uint64))[0] % np.uint64(buckets))
        at += 1


def _dealt(spots: Iterator[int], kind: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows that any bucket can take, in slices."""
    for low in range(0, len(columns[0]), SLICE_ROWS):
        yield (next(spots), kind, *(c[low : low + SLICE_ROWS] for c in columns))


def _scan(sketch: Sketch, words: int, buckets: int):
    """Task function: shingle texts, fold equal sets and parts of a batch, pack the rest."""

    def flush(ids: np.ndarray, sets: list[np.ndarray], spots: Iterator[int]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s) for s in sets], np.int64)
        marks = np.array([[s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s))] for s in sets], np.uint64).reshape(-1, 2)
        marks = mix(marks + mix(sizes.astype(np.uint64))[:, None])
        order = np.lexsort((ids, marks[:, 1], marks[:, 0]))
        linkable = (sizes > 0) & (ids != NO_ID)
        heads = ids.copy()
        kept: dict[tuple, int] = {}
        reps = []
        for i in order[linkable[order]].tolist():
            key = (int(marks[i, 0]), int(marks[i, 1]), int(sizes[i]))
            if key not in kept:
                kept[key] = int(ids[i])
                reps.append(i)
            heads[i] = kept[key]
        rows: list[tuple] = list(_dealt(spots, DOC, ids, heads, sizes))
        reps = np.array(sorted(reps, key=lambda i: ids[i]), np.int64)
        if len(reps):
            firsts = reps[np.argsort(marks[reps, 0], kind="stable")]
            top = ((marks[firsts, 0] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            for b in np.unique(top).tolist():
                own = firsts[top == b]
                rows.append((b, SAME, ids[own], marks[own, 0], marks[own, 1]))
            prints = [sketch.fingerprints(sets[i]) for i in reps.tolist()]
            owners = np.repeat(ids[reps], [len(p) for p in prints])
            prints = np.concatenate(prints)
            order = np.argsort(prints, kind="stable")
            prints, owners = prints[order], owners[order]
            fresh, first, sizes_ = _ties(prints, owners)
            tied = sizes_ > 1
            if tied.any():
                rows += _dealt(spots, TIE, *_counted(owners[tied], first[tied]))
            rows += _by_bucket(prints[fresh], owners[fresh], buckets, PRINT)
        for at in range(0, len(rows), 64):
            yield _packed(rows[at : at + 64])

    def scan(batches):
        hasher, spots = WordHasher(), _spots(buckets)
        ids: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for part in chunks(batch, "text"):
                hashed, counts = hasher(*flat(part.column(1)))
                sets += shingles(hashed, counts, words)
                ids.append(part.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False))
                held += len(hashed)
                if held >= FLUSH_WORDS:
                    yield from flush(np.concatenate(ids), sets, spots)
                    ids, sets, held = [], [], 0
        if ids:
            yield from flush(np.concatenate(ids), sets, spots)

    return scan


def _column(blobs: pd.Series, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, kind) for b in blobs]) if len(blobs) else np.empty(0, kind)


def _meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: ties of equal parts and equal sets to their smallest owner."""
    out = []
    for kind, packed in rows.groupby("kind"):
        a = _column(packed["a"], np.int64)
        if kind in (DOC, TIE):
            out.append((kind, a, _column(packed["b"], np.int64), _column(packed["c"], np.int64)))
        elif kind == SAME:
            x, y = _column(packed["b"], np.uint64), _column(packed["c"], np.uint64)
            order = np.lexsort((a, y, x))
            a, x, y = a[order], x[order], y[order]
            fresh = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            heads = a[fresh][np.cumsum(fresh) - 1]
            moved = heads != a
            out.append((kind, a[moved], heads[moved], np.zeros(moved.sum(), np.int64)))
        else:
            prints = _column(packed["b"], np.uint32)
            order = np.lexsort((a, prints))
            prints, a = prints[order], a[order]
            _, heads, sizes = _ties(prints, a)
            tied = sizes > 1
            out.append((TIE, *_counted(a[tied], heads[tied])))
    frames = [pd.DataFrame({"kind": np.int32(k), "a": a, "b": b, "c": c}) for k, a, b, c in out]
    return pd.concat(frames) if frames else pd.DataFrame({"kind": [], "a": [], "b": [], "c": []})


def _between(labelled: DataFrame) -> DataFrame:
    """Owners of the shingles that more than one component holds.

    ``labelled``: id, label, hashes. ``mask`` has a bit for each size class around the
    owner's in which another component holds the shingle. Owners fold to size classes
    before they meet, so a shingle brings its classes into a group, never its owners.
    """
    sized = labelled.withColumn("n", F.size("hashes").cast("long"))
    sized = sized.withColumn("class", F.floor(F.log("n") / F.log(F.lit(CLASS))))
    rows = sized.select("id", "label", "n", "class", F.explode("hashes").alias("print"))
    folded = rows.groupBy("print", "class").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("owners"))
    prints = folded.groupBy("print").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("owners").alias("owners"),
        F.collect_list(F.struct("class", "low", "high")).alias("spots"),
    )
    prints = materialize(prints.where("low <> high").select("print", "owners", "spots"), "jaccard-prints")
    other = "filter(spots, s -> abs(s.class - class) <= {0} and (s.low <> label or s.high <> label))"
    mask = "aggregate(%s, 0L, (m, s) -> m | shiftleft(1L, cast(s.class - class + {0} as int)))" % other
    found = rows.join(prints, "print").withColumn("mask", F.expr(mask.format(REACH)))
    return materialize(found.select("print", "owners", "id", "label", "n", "class", "mask"), "jaccard-between")


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """Stored shingle sets of some documents: id, n, hashes."""

    def scan(batches):
        hasher = WordHasher()
        for batch in batches:
            for part in chunks(batch, "text"):
                hashed, counts = hasher(*flat(part.column(1)))
                sets = shingles(hashed, counts, words)
                sizes = np.array([len(s) for s in sets], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), lists], names=["id", "n", "hashes"])

    chosen = docs.join(wanted, "id", "left_semi")
    return materialize(chosen.mapInArrow(scan, "id long, n long, hashes array<long>"), "jaccard-sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold, counted exactly."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    met = pairs.join(left, "a").join(right, "b")
    met = met.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    met = met.select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).cast("long").alias("both"))
    return met.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _overlap(k: int, percent: int):
    """Least overlap of a set of size ``n`` with a partner ``k - REACH`` classes above."""
    smallest = F.greatest(F.floor(F.pow(F.lit(CLASS), F.col("class") + k - REACH)) - 1, F.ceil(F.col("n") * percent / 100) - 1)
    return F.ceil((F.col("n") + smallest) * percent / (100 + percent) - 1e-6)


def _both(percent: int):
    """Overlap that two sets of sizes n and n_b need, in whole numbers."""
    return F.ceil((F.col("n") + F.col("n_b")) * percent / (100 + percent) - 1e-6)


def _in_reach(held: DataFrame, percent: int) -> DataFrame:
    """Documents whose hub has another component's document that both reach far enough into the hub to link with.

    Documents of one hub, size and overlap with it count as one profile, so profiles meet, not documents.
    """
    ones = held.select("id", "label", "hub", "n", "reach").distinct()
    profiles = ones.groupBy("hub", "n", "reach").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    others = profiles.select("hub", F.col("n").alias("n_b"), F.col("reach").alias("reach_b"), "low", "high")
    met = profiles.drop("low", "high").join(others, "hub").where(F.least("reach", "reach_b") >= _both(percent))
    met = met.groupBy("hub", "n", "reach").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return ones.join(met, ["hub", "n", "reach"]).where("low <> label or high <> label").select("id")


def _met(left: DataFrame, right: DataFrame, ordered: bool = True, inside: int | None = None) -> DataFrame:
    """(a, b) for rows of different components that share print and hub and whose size classes are open to each other."""
    far = right.select(
        "print", "hub", F.col("id").alias("id_b"), F.col("label").alias("other"), F.col("class").alias("class_b"), F.col("open").alias("open_b"),
        F.col("n").alias("n_b"), F.col("reach").alias("reach_b"),
    )
    allowed = lambda mask, step: F.expr(f"shiftright({mask}, cast(greatest(0, {step} + {REACH}) as int)) & 1") == 1
    met = left.join(far, ["print", "hub"]).where(
        (F.col("label") != F.col("other")) & (F.abs(F.col("class_b") - F.col("class")) <= REACH)
        & allowed("open", "(class_b - class)") & allowed("open_b", "(class - class_b)")
        & (F.col("id") < F.col("id_b") if ordered else F.lit(True))
        & (F.lit(True) if inside is None else F.least("reach", "reach_b") >= _both(inside))
    )
    return met.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b"))


def _candidates(rows: DataFrame, hubs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, n): every pair of different components that can still be linked.

    ``rows``: print, owners, id, label, n, class, open, need. ``hubs``: id, hub, the
    set each document shares most with. What two documents share inside their common
    hub is at most what either shares with the hub. Where that is below the overlap
    they need, they must share a shingle that the hub lacks. So documents meet

    * on shingles outside the hub they have in common,
    * on shingles inside it only in the size classes which their overlap with it reaches,
    * with documents of other hubs on their rarest shingles.

    Copies that drifted too far from the middle of a large group to be linked with it
    thus meet over their own changes, not over the group's text.
    """
    held = rows.join(hubs, "id")
    of_hub = sets.join(hubs.select(F.col("hub").alias("id")).distinct(), "id", "left_semi")
    of_hub = of_hub.select(F.col("id").alias("hub"), F.explode("hashes").alias("print"), F.lit(True).alias("inside"))
    held = held.join(of_hub.distinct(), ["hub", "print"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    held = materialize(held, "jaccard-held")
    order = [F.desc("owners"), F.col("print")]
    held = held.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    held = held.withColumn("place", F.row_number().over(Window.partitionBy("id", "inside").orderBy(*order)))
    held = held.withColumn("reach", F.count_if("inside").over(Window.partitionBy("id")))
    within = sum((F.when(F.col("reach") >= _overlap(k, percent), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(2 * REACH + 1)), F.lit(0))
    held = held.withColumn("within", within.cast("long").bitwiseAND(F.col("open")))
    held = held.where((F.col("rank") >= F.col("need")) | (~F.col("inside") & (F.col("place") >= F.col("need") - F.col("reach"))))
    held = materialize(held.drop("owners"), "jaccard-rare")

    outside = held.where(~F.col("inside") & (F.col("place") >= F.col("need") - F.col("reach")))
    met = _met(outside, outside)
    rare = held.where("rank >= need")
    close = rare.where(F.col("inside") & (F.col("within") != 0)).drop("open").withColumnRenamed("within", "open")
    close = materialize(close.join(_in_reach(close, percent), "id", "left_semi"), "jaccard-close")
    met = met.union(_met(close, close, inside=percent))
    # A row goes to the greater hubs that hold its shingle too, so documents of one hub do not meet again here.
    spots = rare.select("print", "hub").distinct()
    several = spots.groupBy("print").agg(F.count("*").alias("hubs")).where("hubs > 1").select("print")
    mixed = materialize(rare.join(several, "print", "left_semi"), "jaccard-mixed-hubs")
    to = mixed.select("print", F.col("hub").alias("next")).distinct()
    sent = mixed.join(to, "print").where("hub < next").drop("hub").withColumnRenamed("next", "hub")
    met = met.union(_met(sent, mixed, ordered=False))
    return met.groupBy("a", "b").agg(F.count("*").alias("n"))


def _late_links(sets: DataFrame, labels: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links between components, found by counting shared shingles."""
    labelled = sets.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("label"), "hashes")
    between = _between(labelled)

    # A partner of size b shares at least percent / (100 + percent) * (a + b) shingles.
    bits = range(2 * REACH + 1)
    counted = between.groupBy("id", "n", "class").agg(
        *[F.sum(F.shiftright("mask", k).bitwiseAND(F.lit(1))).alias(f"shared{k}") for k in bits]
    )

    overlap = lambda k: _overlap(k, percent)
    reached = [F.col(f"shared{k}") >= overlap(k) for k in bits]
    open_ = sum((F.when(r, F.lit(1 << k)).otherwise(F.lit(0)) for k, r in zip(bits, reached)), F.lit(0)).cast("long")
    need = F.least(*[F.when(r, overlap(k)) for k, r in zip(bits, reached)])
    close = F.greatest(*[F.when(r, F.col(f"shared{k}")) for k, r in zip(bits, reached)]) / F.col("n")
    known = counted.select("id", open_.alias("open"), need.alias("need"), close.alias("close")).where("open <> 0")
    rows = between.join(materialize(known, "jaccard-open"), "id").where(F.col("mask").bitwiseAND(F.col("open")) != 0)
    rows = materialize(rows.select("print", "owners", "id", "label", "n", "class", "open", "need", "close"), "jaccard-rows")

    # The member that shares most is next to what a group of copies was made from.
    centre = rows.groupBy("print").agg(F.max_by(F.struct(F.col("id").alias("b"), F.col("label").alias("other")), F.struct("close", -F.col("id"))).alias("c"))
    stars = rows.join(centre, "print").groupBy(F.col("id").alias("a"), F.col("c.b").alias("b"))
    stars = stars.agg(F.count("*").alias("n"), F.max(F.col("label") != F.col("c.other")).alias("apart"))
    stars = materialize(stars, "jaccard-stars")
    hubs = materialize(stars.groupBy(F.col("a").alias("id")).agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("hub")), "jaccard-hubs")
    stars = stars.where("apart").groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    found = materialize(_verified(stars, sets, percent), "jaccard-links")
    labels = materialize(components(links.union(found)), "jaccard-labels")

    rows = rows.drop("label").join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    rows = materialize(rows, "jaccard-rows")
    mixed = rows.groupBy("print").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("print")
    rows = materialize(rows.join(materialize(mixed, "jaccard-mixed"), "print"), "jaccard-rows")
    enough = rows.groupBy("id").agg(F.count("*").alias("held"), F.min("need").alias("least")).where("held >= least").select("id")
    pairs = materialize(_candidates(rows.join(enough, "id", "left_semi"), hubs, sets, percent), "jaccard-pairs")
    for _ in range(BEST_ROUNDS):
        # Each document's likeliest pair first: what it links makes other pairs needless.
        ends = pairs.union(pairs.select("b", "a", "n"))
        best = ends.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
        best = materialize(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-best")
        found = materialize(found.union(_verified(best, sets, percent)), "jaccard-links")
        labels = materialize(components(links.union(found)), "jaccard-labels")
        left = pairs.join(best, ["a", "b"], "left_anti")
        left = left.join(labels.select(F.col("id").alias("a"), F.col("component").alias("la")), "a", "left")
        left = left.join(labels.select(F.col("id").alias("b"), F.col("component").alias("lb")), "b", "left")
        apart = F.coalesce("la", "a") != F.coalesce("lb", "b")
        pairs = materialize(left.where(apart).select("a", "b", "n"), "jaccard-pairs")
        if not pairs.count():
            return found
    return found.union(materialize(_verified(pairs.select("a", "b"), sets, percent), "jaccard-links"))


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75
) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id."""
    spark = docs.sparkSession
    sketch = Sketch(percent)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chars, total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS), -(-total // BUCKET_ROWS))
    packed = rows.mapInArrow(_scan(sketch, words, buckets), PACKED_DDL)
    met = materialize(packed.groupBy("bucket").applyInPandas(_meet, "kind int, a long, b long, c long"), "jaccard-ties")

    members = met.where(F.col("kind") == DOC).select(F.col("a").alias("id"), F.col("b").alias("head"), F.col("c").alias("n"))
    same = met.where(F.col("kind") == SAME).groupBy("a").agg(F.min("b").alias("class"))
    same = materialize(same.withColumnRenamed("a", "head"), "jaccard-classes")

    def classed(df: DataFrame, column: str) -> DataFrame:
        known = same.select(F.col("head").alias(column), "class")
        return df.join(known, column, "left").withColumn(column, F.coalesce("class", column)).drop("class")

    ties = met.where(F.col("kind") == TIE).groupBy("a", "b").agg(F.sum("c").alias("c"))
    ties = classed(classed(ties, "a"), "b").groupBy("a", "b").agg(F.sum("c").alias("c"))
    ties = materialize(ties, "jaccard-class-ties")
    shared = ties.groupBy("a").agg(F.sum("c").alias("shared"))
    sizes = members.groupBy(F.col("id").alias("a")).agg(F.min("n").alias("n"))
    least = F.ceil(F.col("n") * percent / 100)
    enough = F.col("shared") >= 1 + F.floor(F.lit(sketch.margin) * least)
    other = ties.where("a <> b")
    involved = other.select("a").union(other.select(F.col("b").alias("a"))).distinct()
    active = shared.join(sizes, "a").where(enough).join(involved, "a", "left_semi").select(F.col("a").alias("id"))
    active = materialize(active, "jaccard-active")
    sets = _sets_of(rows, active, words)

    best = other.join(active.withColumnRenamed("id", "a"), "a", "left_semi")
    best = best.join(active.withColumnRenamed("id", "b"), "b", "left_semi")
    best = best.groupBy("a").agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("b"))
    links = materialize(_verified(best, sets, percent), "jaccard-links")

    labels = materialize(components(links), "jaccard-labels")
    late = _late_links(sets, labels, links, percent)
    labels = materialize(components(links.union(late)), "jaccard-labels").withColumnRenamed("id", "class_id")
    result = classed(members, "head").join(labels, F.col("head") == F.col("class_id"), "left")
    known = F.when(F.col("id") != F.lit(int(NO_ID)), F.col("id"))
    return result.select(
        known.alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(known.isNotNull(), F.coalesce("component", "head")).alias("component_id"),
    )


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """The documents with the smallest identifier of their component, with all their columns."""
    groups = similar_groups(docs, id_col, text_col, words, percent)
    mark = "__identity"
    while mark in docs.columns:
        mark += "_"
    stay = materialize(groups.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(mark)).distinct(), "jaccard-kept")
    marked = docs.withColumn(mark, F.col(id_col).cast("long"))
    kept = marked.where(F.col(mark).isNotNull()).join(stay, mark, "left_semi").dropDuplicates([mark])
    return kept.select(*docs.columns).union(marked.where(F.col(mark).isNull()).select(*docs.columns))
