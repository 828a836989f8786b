"""Product quantisation: short codes of vectors for a first list, exact distances for its order.

A vector is cut into ``PARTS`` parts; each part is replaced by the number, one byte, of
the nearest of at most 256 centroids of that part. A query's distances to all centroids
form a table, and the distance to a coded vector is the sum of one entry for each part. The
best ``first`` of each query by that sum are measured exactly.

Centroids come from at most ``TRAIN_ROWS`` vectors, those with the least hash of their
identifier, and are trained part by part in tasks of their own; the codebooks have a fixed
size (256 centroids of the vector's length). All vectors are coded. Codes and vectors
are columns of one table sorted by nothing in particular: the first list reads codes
only, and exact search over all vectors stands beside it (``knn.similar``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopspark.operators.knn import DIGITS, QUERY_BLOCK, query_blocks, slices, top_k, unit
from shopspark.storage import materialize

PARTS = 16
CENTROIDS = 256
TRAIN_ROWS = 20_000
ROUNDS = 12
FIRST = 100
PACK_ROWS = 1 << 15


def _stack(vectors) -> np.ndarray:
    return unit(np.stack([np.asarray(v) for v in vectors]).astype(np.float64))


def train(rows: np.ndarray, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from distinct starting rows; a centroid without rows stays where it is."""
    distinct = np.unique(rows, axis=0)
    chosen = distinct[np.random.default_rng(seed).permutation(len(distinct))[:centroids]]
    for _ in range(rounds):
        near = nearest(rows, chosen)
        order = np.argsort(near, kind="stable")
        taken, starts = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(rows[order], starts, axis=0)
        chosen[taken] = sums / np.diff(np.append(starts, len(rows)))[:, None]
    return chosen


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    lengths, found = (centroids**2).sum(axis=1)[None, :], np.empty(len(rows), np.int64)
    for cut in slices(len(rows), len(centroids)):
        found[cut] = (lengths - 2 * rows[cut] @ centroids.T).argmin(axis=1)
    return found


@dataclass(frozen=True)
class CodeIndex:
    path: str
    #: One array (centroids, width) for each part.
    books: tuple[np.ndarray, ...]

    def read(self, spark) -> DataFrame:
        return spark.read.schema("id bigint, code binary, v array<float>").parquet(self.path)


def _books(sample: DataFrame, parts: int, seed: int) -> tuple[np.ndarray, ...]:
    def fit(key, rows: pd.DataFrame) -> pd.DataFrame:
        book = train(np.stack(rows["cut"].to_numpy()).astype(np.float64), seed=seed)
        return pd.DataFrame([{"part": key[0], "width": book.shape[1], "book": book.tobytes()}])

    width = F.size("v") / parts
    cuts = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(
        p.alias("part"), F.slice("v", F.floor(p * width).cast("int") + 1, (F.floor((p + 1) * width) - F.floor(p * width)).cast("int")).alias("cut")
    ))
    spelled = sample.select(F.explode(cuts).alias("c")).select("c.part", "c.cut")
    found = spelled.groupBy("part").applyInPandas(fit, "part int, width int, book binary").collect()  # one row for each part
    return tuple(np.frombuffer(r["book"], np.float64).reshape(-1, r["width"]) for r in sorted(found, key=lambda r: r["part"]))


def build_codes(corpus: DataFrame, path: str, key: str = "id", vector: str = "embedding", parts: int = PARTS, seed: int = 7) -> CodeIndex:
    """Train the codebooks, code every vector and write id, code and vector."""

    @F.pandas_udf("array<double>")
    def unit_length(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(_stack(vectors))) if len(vectors) else vectors

    rows = corpus.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where(F.col("v").isNotNull())
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)
    books = _books(sample.select(unit_length("v").alias("v")), parts, seed)
    edges = np.cumsum([0, *[b.shape[1] for b in books]])

    @F.pandas_udf("binary")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            data = _stack(batch)
            codes = np.stack([nearest(data[:, a:b], book) for a, b, book in zip(edges, edges[1:], books)], axis=1).astype(np.uint8)
            yield pd.Series([row.tobytes() for row in codes])

    rows.select("id", coded("v").alias("code"), "v").write.parquet(path)
    return CodeIndex(path, books)


def _code_packs(codes: DataFrame) -> DataFrame:
    """(ids, codes): coded rows packed where they lie."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= PACK_ROWS:
                yield packed(held)
                held, count = [], 0
        if count:
            yield packed(held)

    def packed(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held)
        return pd.DataFrame([{"ids": rows["id"].to_numpy(np.int64).tobytes(), "codes": b"".join(rows["code"])}])

    return codes.mapInPandas(pack, "ids binary, codes binary")


def _first_lists(books: tuple[np.ndarray, ...], first: int, skip_self: bool):
    edges = np.cumsum([0, *[b.shape[1] for b in books]])

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples():
                ids, asking = np.frombuffer(row.ids, np.int64), np.frombuffer(row.query_ids, np.int64)
                codes = np.frombuffer(row.codes, np.uint8).reshape(len(ids), len(books))
                queries = np.frombuffer(row.queries, np.float64).reshape(len(asking), -1)
                for cut in slices(len(asking), len(books) * CENTROIDS):
                    # Of unit vectors the nearest have the largest products.
                    tables = [queries[cut, a:b] @ book.T for a, b, book in zip(edges, edges[1:], books)]
                    out = []
                    for q, asker in enumerate(asking[cut]):
                        far = -sum(table[q][codes[:, p]] for p, table in enumerate(tables))
                        if skip_self:
                            far[ids == asker] = np.inf
                        n = min(first, len(ids))
                        spots = np.argpartition(far, n - 1)[:n]
                        spots = spots[np.isfinite(far[spots])]
                        out.append((np.full(len(spots), asker), ids[spots], np.round(far[spots], DIGITS)))
                    queries_, found, far = (np.concatenate(c) for c in zip(*out))
                    yield pd.DataFrame({"query_id": queries_, "id": found, "distance": far})

    return listed


def similar_by_codes(
    index: CodeIndex, queries: DataFrame, k: int, first: int = FIRST, query_key: str = "id", query_vector: str = "embedding",
    skip_self: bool = False,
) -> DataFrame:
    """(query_id, id, distance, rank) as ``knn.similar``, of the ``first`` rows whose codes come nearest."""
    asking = queries.select(F.col(query_key).cast("long").alias("id"), F.col(query_vector).alias("v"), F.lit(0).alias("cell"))
    stored = index.read(queries.sparkSession)
    blocks = query_blocks(asking, QUERY_BLOCK).select("query_ids", "queries", "block", "blocks")
    most = blocks.agg(F.max("blocks")).first()[0] or 0
    numbers = F.sequence(F.lit(0), F.lit(most - 1)) if most else F.array().cast("array<int>")
    met = _code_packs(stored.select("id", "code")).withColumn("block", F.explode(numbers)).join(blocks.drop("blocks"), "block")
    lists = met.mapInPandas(_first_lists(index.books, first, skip_self), "query_id long, id long, distance double")
    lists = materialize(top_k(lists, first).select("query_id", "id"), "first-lists")

    @F.pandas_udf("double")
    def exact(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.round(1.0 - (_stack(a) * _stack(b)).sum(axis=1), DIGITS) if len(a) else [], dtype=float)

    pairs = lists.join(stored.select("id", "v"), "id").join(asking.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    measured = pairs.where(F.col("q").isNotNull()).select("query_id", "id", exact("q", "v").alias("distance"))
    return top_k(measured, k)
