"""Exact top-k search by three phases with a uniform threshold.

The components are dealt into ``LISTS`` groups; a group's partial products are a
score list. Query vectors and candidates meet in blocks, every pair of blocks
once.

1. Each pair of blocks gathers, for every query, the best entries of each list and
   resolves their whole scores. The k-th best score over all blocks is a lower
   bound for the query's k-th best: a safe cutoff.
2. The cutoff goes back to the query's block. An entry can reach it only if one of
   its partial scores reaches a ``LISTS``-th of it, so entries under that in every
   list are left out.
3. The scores of the others are resolved exactly; each pair of blocks gives its k
   best at or above the cutoff, ties to the smaller identifier, and the k best of
   those are the answer.

Products are exact: integers in double precision as long as no sum can pass 2^53,
Python integers beyond. Blocks are dealt by a hash of the identifier and have a
fixed number of rows, so a task's memory does not follow the table. Every query
row is compared with every other row, in blocks; only k rows for each query and
block are ever shuffled.

Defined cases: vectors that are null, empty or hold null or non-finite components,
and rows without identifier, take no part. Rows with equal identifiers are one
vector. Vectors of different length are not compared. A score beyond 64 bits counts
as the nearest 64-bit value, and a component that is not finite when scaled as not
finite. An empty table gives an empty result. Other columns are not looked
at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopspark.storage import materialize

LISTS = 4
SCALE = 64
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
CELLS = 1 << 20
NONE = np.iinfo(np.int64).min
MOST = int(np.iinfo(np.int64).max)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (doubles), dim of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (SCALE * F.abs(x) < float("inf")))
    whole = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector) > 0) & good
    return rows.where(whole).select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), F.size(vector).alias("dim"))


def _blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Vectors packed into blocks numbered from 0 within each length: dim, block, blocks, ids, data."""
    per_dim = vectors.groupBy("dim").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    dealt = vectors.join(per_dim, "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates("id").sort_values("id")
        data = np.floor(SCALE * np.stack(block["vector"].to_numpy()).astype(np.float64))
        if np.abs(data).max() < 2**31:
            data = data.astype(np.int32)
        first = block.iloc[0]
        return pd.DataFrame(
            [{"dim": first["dim"], "block": first["block"], "blocks": first["blocks"],
              "ids": block["id"].to_numpy(np.int64).tobytes(), "data": data.tobytes()}]
        )

    schema = "dim int, block int, blocks int, ids binary, data binary"
    return materialize(dealt.groupBy("dim", "block").applyInPandas(pack, schema), name)


def whole_numbers(scores: np.ndarray) -> np.ndarray:
    """64-bit scores; one beyond that range counts as its nearest value (the least is kept for no score)."""
    if scores.dtype == object:
        scores = np.clip(scores, int(NONE) + 1, MOST)
    return scores.astype(np.int64)


class Pair:
    """A block of queries against a block of candidates: partial scores by list."""

    def __init__(self, row):
        self.dim = int(row.dim)
        self.query_ids, self.ids = np.frombuffer(row.query_ids, np.int64), np.frombuffer(row.ids, np.int64)
        queries, data = self._matrix(row.queries, len(self.query_ids)), self._matrix(row.data, len(self.ids))
        if np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * self.dim >= 2**50:
            to_int = np.frompyfunc(int, 1, 1)
            queries, data = to_int(queries), to_int(data)
        self.queries, self.data = queries, data

    def _matrix(self, packed: bytes, rows: int) -> np.ndarray:
        kind = np.int32 if len(packed) == 4 * rows * self.dim else np.float64
        return np.frombuffer(packed, kind).reshape(rows, self.dim).astype(np.float64)

    def slices(self):
        step = max(1, CELLS // max(1, len(self.ids)))
        for at in range(0, len(self.query_ids), step):
            yield slice(at, at + step)

    def lists(self, part: slice) -> list[np.ndarray]:
        cuts = [self.dim * i // LISTS for i in range(LISTS + 1)]
        return [self.queries[part, low:high] @ self.data[:, low:high].T for low, high in zip(cuts, cuts[1:])]

    def own(self, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which a query meets its own row (identifiers are sorted)."""
        queries = self.query_ids[part]
        at = np.minimum(np.searchsorted(self.ids, queries), len(self.ids) - 1)
        hit = np.flatnonzero(self.ids[at] == queries)
        return hit, at[hit]


def _gather(k: int):
    """Phase 1: (query_id, score) of the best entries of the lists, resolved, k for each query at most."""

    def gather(batches):
        for rows in batches:
            for row in rows.itertuples():
                pair = Pair(row)
                for part in pair.slices():
                    lists = pair.lists(part)
                    own = pair.own(part)
                    n = len(pair.ids)
                    top = min(k + 1, n)
                    found = [np.argpartition(p, n - top, axis=1)[:, n - top :] for p in lists]
                    spots = np.sort(np.concatenate(found, axis=1), axis=1)
                    repeated = np.concatenate([np.zeros((len(spots), 1), bool), spots[:, 1:] == spots[:, :-1]], axis=1)
                    mine = np.full(len(spots), -1)
                    mine[own[0]] = own[1]
                    out = repeated | (spots == mine[:, None])
                    scores = np.where(out, NONE, whole_numbers(sum(np.take_along_axis(p, spots, axis=1) for p in lists)))
                    scores = np.sort(scores, axis=1)[:, ::-1][:, :k]
                    queries = np.repeat(pair.query_ids[part], scores.shape[1])
                    flat = scores.ravel()
                    good = flat > NONE
                    yield pd.DataFrame({"query_id": queries[good], "score": flat[good]})

    return gather


def _resolve(k: int):
    """Phases 2 and 3: the k best entries at or above the cutoff of each query."""

    def resolve(batches):
        for rows in batches:
            for row in rows.itertuples():
                pair = Pair(row)
                known = dict(zip(np.frombuffer(row.cut_ids, np.int64).tolist(), np.frombuffer(row.cuts, np.int64).tolist()))
                cutoffs = np.array([known.get(q, NONE) for q in pair.query_ids.tolist()], np.int64)
                for part in pair.slices():
                    lists = pair.lists(part)
                    least = cutoffs[part][:, None]
                    # The least cutoff stands for all scores that low.
                    open_ = np.broadcast_to(least <= NONE + 1, lists[0].shape).copy()
                    for p in lists:
                        open_ |= (p * LISTS >= least).astype(bool)
                    open_[pair.own(part)] = False
                    q, v = np.nonzero(open_)
                    score = whole_numbers(sum(p[q, v] for p in lists))
                    good = score >= cutoffs[part][q]
                    q, v, score = q[good], v[good], score[good]
                    order = np.lexsort((v, ~score, q))
                    q, v, score = q[order], v[order], score[order]
                    starts = np.searchsorted(q, q, "left")
                    top = np.arange(len(q)) - starts < k
                    yield pd.DataFrame(
                        {"query_id": pair.query_ids[part][q[top]], "vec_id": pair.ids[v[top]], "score": score[top]}
                    )

    return resolve


def _best(scored: DataFrame, order: list, k: int) -> DataFrame:
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def exact_top_k(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20,
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The k nearest rows of each row whose identifier is divisible by ``every``: query_id, rank, vec_id, score."""
    vectors = usable(rows, id_col, vector_col)
    candidates = _blocks(vectors, block_rows, "topk-candidates")
    queries = _blocks(vectors.where(F.col("id") % every == 0), query_rows, "topk-queries")
    queries = queries.select("dim", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("data").alias("queries"))
    counts = candidates.select("dim", "blocks").distinct()

    def met(side: DataFrame) -> DataFrame:
        """Every query block with every candidate block of its length, by the candidate block's number."""
        spread = side.join(counts, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return spread.join(candidates.drop("blocks"), ["dim", "block"])

    local = met(queries).mapInPandas(_gather(k), "query_id long, score long")
    kth = _best(local, [F.desc("score")], k).groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count("*").alias("n"))
    kth = kth.where(F.col("n") == k).select("query_id", "cutoff")
    members = queries.select("dim", "query_block", "query_ids")

    def spelled(batches):
        for part in batches:
            for row in part.itertuples():
                yield pd.DataFrame({"dim": row.dim, "query_block": row.query_block, "query_id": np.frombuffer(row.query_ids, np.int64)})

    where = members.mapInPandas(spelled, "dim int, query_block int, query_id long")

    def cuts(block: pd.DataFrame) -> pd.DataFrame:
        block = block.dropna(subset=["cutoff"])
        return pd.DataFrame({"cut_ids": [block["query_id"].to_numpy(np.int64).tobytes()], "cuts": [block["cutoff"].to_numpy(np.int64).tobytes()]})

    keyed = where.join(kth, "query_id", "left").groupBy("dim", "query_block").applyInPandas(
        lambda key, b: cuts(b).assign(dim=key[0], query_block=key[1])[["dim", "query_block", "cut_ids", "cuts"]],
        "dim int, query_block int, cut_ids binary, cuts binary",
    )
    ready = materialize(queries.join(keyed, ["dim", "query_block"]), "topk-cutoffs")
    found = met(ready).mapInPandas(_resolve(k), "query_id long, vec_id long, score long")
    return _best(found, [F.desc("score"), F.col("vec_id")], k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
