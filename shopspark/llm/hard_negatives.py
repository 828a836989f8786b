"""Hard negatives by Kronecker-packed products.

The integer components of several candidates are biased to be non-negative and put
into separate fields of one wide integer, one such integer for each component. An
anchor's component multiplies it once and so multiplies every candidate in it; the
sum over the components holds all their inner products, each in its own field, and
none runs into the next because a field is wider than the largest possible sum. The
fields are unpacked and freed of the biases, so the scores are exact.

The wide integer is the 53-bit one of a double while two fields fit into it (the
products then are matrix products), and a Python integer of any width otherwise.

Anchors and candidates meet in blocks of a fixed number of rows, every pair of blocks
once in each of two passes. The first finds the positives: the best ``POSITIVES``
rows of the anchor's label. They go back to the anchor's block, and the second pass
takes from each block the best rows of other labels within the share of the positive's
score. Blocks are dealt by a hash of the identifier, so neither a label nor a vector
that many rows have makes a group; a task holds two blocks, and only the best rows of
each anchor and block are shuffled.

Defined cases: rows with a null identifier, label or vector, an empty vector or a null
component or one that is not finite when scaled take no part. Rows with one identifier are one row: the one
with the least label, then vector. Vectors of different length are not compared. Ties
go to the smaller identifier. A score beyond 64 bits counts as the nearest 64-bit
value. Without positives an anchor has no rows; an empty table gives none. Other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopspark.storage import materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score in hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
BLOCK_ROWS = 8192
ANCHOR_ROWS = 512
CELLS = 1 << 20
#: Fields of one Python integer where doubles are too narrow.
WIDE_FIELDS = 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def labelled_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, vector, dim: one row for each identifier that takes part."""
    vector = F.col(vector_col).cast("array<double>")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (SCALE * F.abs(x) < float("inf")))
    whole = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector) > 0) & good
    kept = rows.where(whole).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"))
    one = kept.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return one.select("id", "row.label", "row.vector", F.size("row.vector").alias("dim"))


def _blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Vectors packed into blocks numbered from 0 within each length: dim, block, blocks, ids, labels, data."""
    per_dim = vectors.groupBy("dim").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    dealt = vectors.join(per_dim, "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id")
        data = np.floor(SCALE * np.stack(block["vector"].to_numpy()).astype(np.float64))
        first = block.iloc[0]
        return pd.DataFrame(
            [{"dim": first["dim"], "block": first["block"], "blocks": first["blocks"], "ids": block["id"].to_numpy(np.int64).tobytes(),
              "labels": block["label"].to_numpy(np.int64).tobytes(), "data": data.tobytes()}]
        )

    schema = "dim int, block int, blocks int, ids binary, labels binary, data binary"
    return materialize(dealt.groupBy("dim", "block").applyInPandas(pack, schema), name)


class PackedProducts:
    """Inner products of anchors with a block of candidates, several candidates a multiplication.

    Both sides hold whole numbers as doubles, one row for each vector.
    """

    def __init__(self, anchors: np.ndarray, candidates: np.ndarray):
        self.n, dim = candidates.shape
        self.bias_a, self.bias_c = (max(0, -int(m.min(initial=0))) for m in (anchors, candidates))
        top_a, top_c = (int(m.max(initial=0)) + b for m, b in ((anchors, self.bias_a), (candidates, self.bias_c)))
        self.bits = max(1, (dim * top_a * top_c).bit_length())
        self.fields = 53 // self.bits
        self.doubles = self.fields >= 2
        if not self.doubles:
            self.fields = WIDE_FIELDS
            to_int = np.frompyfunc(int, 1, 1)
            anchors, candidates = to_int(anchors), to_int(candidates)
        self.anchors = anchors + self.bias_a
        # Freed of the biases: (a + p)(c + q) = ac + qa + pc + pq, summed over the components.
        self.of_anchor = self.bias_c * anchors.sum(axis=1) + dim * self.bias_a * self.bias_c
        self.of_candidate = self.bias_a * candidates.sum(axis=1)
        biased = candidates + self.bias_c
        wide = -(-self.n // self.fields)
        empty = np.zeros((wide * self.fields - self.n, dim), biased.dtype)
        columns = np.concatenate([biased, empty]).reshape(wide, self.fields, dim)
        weight = np.array([1 << (self.bits * f) for f in range(self.fields)], np.float64 if self.doubles else object)
        self.packed = (columns * weight[None, :, None]).sum(axis=1).T

    def scores(self, part: slice) -> np.ndarray:
        """Rows for the anchors of ``part``, columns for the candidates; 64-bit integers."""
        sums = self.anchors[part] @ self.packed
        if self.doubles:
            sums = sums.astype(np.int64)
        mask = (1 << self.bits) - 1
        fields = np.stack([(sums >> (self.bits * f)) & mask for f in range(self.fields)], axis=2)
        flat = fields.reshape(len(sums), -1)[:, : self.n]
        exact = flat - (self.of_anchor[part][:, None] + self.of_candidate[None, :])
        if not self.doubles:
            return np.clip(exact, LEAST, MOST).astype(np.int64)
        return exact.astype(np.int64)


class Meeting:
    """A block of anchors and a block of candidates."""

    def __init__(self, row):
        self.anchor_ids, self.anchor_labels = np.frombuffer(row.anchor_ids, np.int64), np.frombuffer(row.anchor_labels, np.int64)
        self.ids, self.labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
        shaped = lambda data, n: np.frombuffer(data, np.float64).reshape(n, int(row.dim))
        self.products = PackedProducts(shaped(row.anchors, len(self.anchor_ids)), shaped(row.data, len(self.ids)))

    def each(self):
        """(anchor's position, scores of all candidates), a bounded part of the scores at a time."""
        step = max(1, CELLS // len(self.ids))
        for at in range(0, len(self.anchor_ids), step):
            yield from enumerate(self.products.scores(slice(at, at + step)), at)


def _best(scores: np.ndarray, spots: np.ndarray, k: int) -> np.ndarray:
    """Of ``spots`` (ascending) the k with the highest scores, ties to the earlier one."""
    if len(spots) > 4 * k:
        least = np.partition(scores[spots], len(spots) - k)[len(spots) - k]
        spots = spots[scores[spots] >= least]
    # The complement turns the order round without overflow at the least 64-bit value.
    return spots[np.argsort(~scores[spots], kind="stable")[:k]]


def _positives(k: int):
    def find(batches):
        for rows in batches:
            for row in rows.itertuples():
                met = Meeting(row)
                out = []
                for a, scores in met.each():
                    same = np.flatnonzero((met.labels == met.anchor_labels[a]) & (met.ids != met.anchor_ids[a]))
                    best = _best(scores, same, k)
                    out.append((np.full(len(best), met.anchor_ids[a]), met.ids[best], scores[best]))
                anchors, ids, scores = (np.concatenate(c) for c in zip(*out))
                yield pd.DataFrame({"anchor_id": anchors, "positive_id": ids, "positive_score": scores})

    return find


def _negatives(k: int, lowest: int, highest: int):
    def find(batches):
        for rows in batches:
            for row in rows.itertuples():
                met = Meeting(row)
                wanted: dict[int, list] = {}
                for anchor, score in zip(*(np.frombuffer(c, np.int64).tolist() for c in (row.of_anchors, row.of_scores))):
                    wanted.setdefault(anchor, []).append(score)
                out = []
                for a, scores in met.each():
                    anchor = int(met.anchor_ids[a])
                    other = met.labels != met.anchor_labels[a]
                    for score in dict.fromkeys(wanted.get(anchor, [])):
                        low, high = -(-lowest * score // 100), highest * score // 100
                        spots = np.flatnonzero(other & (scores >= max(low, LEAST)) & (scores <= min(high, MOST)))
                        best = _best(scores, spots, k)
                        n = len(best)
                        out.append((np.full(n, anchor), np.full(n, score), met.ids[best], scores[best]))
                if out:
                    names = ("anchor_id", "positive_score", "negative_id", "negative_score")
                    yield pd.DataFrame({name: np.concatenate(c) for name, c in zip(names, zip(*out))})

    return find


def _pack_positives(key, block: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(
        [{"dim": key[0], "anchor_block": key[1], "of_anchors": block["anchor_id"].to_numpy(np.int64).tobytes(),
          "of_scores": block["positive_score"].to_numpy(np.int64).tobytes()}]
    )


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST,
    highest: int = HIGHEST, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` comes from ``labelled_vectors``. Anchors are the rows whose identifier is divisible by
    ``every``. A negative has another label and ``lowest`` to ``highest`` hundredths of the positive's score.
    """
    vectors = materialize(vectors, "negatives-vectors")
    candidates = _blocks(vectors, block_rows, "negatives-candidates")
    anchors = _blocks(vectors.where(F.col("id") % every == 0), anchor_rows, "negatives-anchors").select(
        "dim", F.col("block").alias("anchor_block"), F.col("ids").alias("anchor_ids"), F.col("labels").alias("anchor_labels"),
        F.col("data").alias("anchors"),
    )
    counts = candidates.select("dim", "blocks").distinct()

    def met(side: DataFrame) -> DataFrame:
        """Every block of anchors with every block of candidates of its length."""
        spread = side.join(counts, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return spread.join(candidates.drop("blocks"), ["dim", "block"])

    found = met(anchors).mapInPandas(_positives(positives), "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = materialize(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives).drop("n"), "negatives-positives")

    def spelled(batches):
        for part in batches:
            for row in part.itertuples():
                yield pd.DataFrame({"dim": row.dim, "anchor_block": row.anchor_block, "anchor_id": np.frombuffer(row.anchor_ids, np.int64)})

    places = anchors.select("dim", "anchor_block", "anchor_ids").mapInPandas(spelled, "dim int, anchor_block int, anchor_id long")
    packed = places.join(found, "anchor_id").groupBy("dim", "anchor_block").applyInPandas(
        _pack_positives, "dim int, anchor_block int, of_anchors binary, of_scores binary"
    )
    ready = materialize(anchors.join(packed, ["dim", "anchor_block"]), "negatives-asked")
    mined = met(ready).mapInPandas(
        _negatives(negatives, lowest, highest), "anchor_id long, positive_score long, negative_id long, negative_score long"
    )
    # Positives of one score ask for the same rows, so they are found once.
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    mined = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return mined.join(found, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


def mined_report(rows: DataFrame) -> DataFrame:
    """Hard negatives of the embeddings' table; every seventh label is moved on by one."""
    vectors = labelled_vectors(rows)
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved))
