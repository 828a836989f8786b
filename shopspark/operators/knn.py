"""Nearest vectors by cosine: exact, and approximate by cells.

Queries stay in Spark: they are packed into blocks of a fixed number of rows. In the
search by cells the corpus is packed where it lies, and a block meets a pack in an equi
join on the cell and the number of the block. In exact search one block of queries,
which Spark broadcasts by its own measure, meets the packs where they lie; of several
blocks, each goes to every numbered pack, so the corpus is shuffled once and never
copied. A pack gives at most k rows per query, and a window with a limit merges them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopspark.storage import materialize

QUERY_BLOCK = 2048
#: Bytes of the vectors of a pack, and scores that a task holds at once.
PACK_BYTES = 8 << 20
SCORES = 1 << 19
DIGITS = 10
#: Cells of an index at most, so that the centroids which every task holds have a fixed size.
MOST_CELLS = 4096


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _stack(vectors) -> np.ndarray:
    return np.stack([np.asarray(v) for v in vectors]).astype(np.float64)


def pack_rows(width: int) -> int:
    """Vectors of this many components that a pack holds, as doubles."""
    return max(1, PACK_BYTES // (8 * max(1, width)))


def slices(count: int, width: int) -> Iterator[slice]:
    """Cuts of ``count`` rows so that rows times ``width`` scores stay few."""
    step = max(1, SCORES // max(1, width))
    for at in range(0, count, step):
        yield slice(at, at + step)


def _pack(rows: pd.DataFrame) -> dict:
    return {"ids": rows["id"].to_numpy(np.int64).tobytes(), "data": unit(_stack(rows["v"])).tobytes()}


def packs(corpus: DataFrame) -> DataFrame:
    """(cell, ids, data): the rows of each task (id, v, cell) packed by cell."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        counts: dict[int, int] = {}
        for batch in filter(len, batches):
            most = pack_rows(len(batch["v"].iloc[0]))
            for cell, whole in batch.groupby("cell"):
                while len(whole):
                    rows = whole.iloc[: most - counts.get(cell, 0)]
                    whole = whole.iloc[len(rows) :]
                    held.setdefault(cell, []).append(rows)
                    counts[cell] = counts.get(cell, 0) + len(rows)
                    if counts[cell] >= most:
                        yield pd.DataFrame([{"cell": cell, **_pack(pd.concat(held.pop(cell)))}])
                        del counts[cell]
            while sum(counts.values()) > 2 * most:  # many cells in one task: let the largest go
                cell = max(counts, key=counts.get)
                yield pd.DataFrame([{"cell": cell, **_pack(pd.concat(held.pop(cell)))}])
                del counts[cell]
        for cell, parts in held.items():
            yield pd.DataFrame([{"cell": cell, **_pack(pd.concat(parts))}])

    given = corpus.where(F.col("v").isNotNull()).select("id", "v", "cell")
    return given.mapInPandas(pack, "cell int, ids binary, data binary")


def numbered_packs(corpus: DataFrame) -> tuple[DataFrame, int]:
    """(pack, ids, data): the corpus dealt by a hash into packs numbered from 0, and how many there are."""
    given = corpus.where(F.col("v").isNotNull()).select("id", "v")
    count, width = given.agg(F.count("*"), F.max(F.size("v"))).first()
    number = max(1, -(-count // pack_rows(width or 1)))
    dealt = given.withColumn("pack", F.pmod(F.xxhash64("id"), F.lit(number)).cast("int"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"pack": rows["pack"].iloc[0], **_pack(rows)}])

    return dealt.groupBy("pack").applyInPandas(pack, "pack int, ids binary, data binary"), number


def query_blocks(queries: DataFrame, size: int) -> DataFrame:
    """(cell, block, blocks, query_ids, queries) from rows (id, v, cell); null vectors ask nothing."""
    given = queries.where(F.col("v").isNotNull())
    counts = given.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = given.join(counts, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        first, packed = rows.iloc[0], _pack(rows)
        return pd.DataFrame(
            [{"cell": first["cell"], "block": first["block"], "blocks": first["blocks"],
              "query_ids": packed["ids"], "queries": packed["data"]}]
        )

    schema = "cell int, block int, blocks int, query_ids binary, queries binary"
    return materialize(dealt.groupBy("cell", "block").applyInPandas(pack, schema), "query-blocks")


def _best_of_pack(k: int, skip_self: bool):
    """Per block and pack: the k nearest rows of every query, ties to the lower id."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples():
                ids, asking = np.frombuffer(row.ids, np.int64), np.frombuffer(row.query_ids, np.int64)
                data = np.frombuffer(row.data, np.float64).reshape(len(ids), -1)
                queries = np.frombuffer(row.queries, np.float64).reshape(len(asking), -1)
                for cut in slices(len(asking), len(ids)):
                    part = asking[cut]
                    far = queries[cut] @ data.T
                    np.subtract(1.0, far, out=far)
                    # One rounded key decides here and in the merge.
                    np.round(far, DIGITS, out=far)
                    if skip_self:
                        far[part[:, None] == ids[None, :]] = np.inf
                    last = min(k, len(ids)) - 1
                    limit = np.partition(far, last, axis=1)[:, last : last + 1]
                    q, i = np.nonzero((far <= limit) & np.isfinite(far))
                    order = np.lexsort((ids[i], far[q, i], q))
                    q, i = q[order], i[order]
                    top = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
                    q, i = q[top], i[top]
                    yield pd.DataFrame({"query_id": part[q], "id": ids[i], "distance": far[q, i]})

    return best


def top_k(candidates: DataFrame, k: int) -> DataFrame:
    """Best k rows per query: lowest distance, then lowest id. Spark cuts each task's rows to k before it shuffles."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.asc("distance"), F.asc("id")))
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= k)


def _search(corpus: DataFrame, queries: DataFrame, k: int, skip_self: bool, cells: bool) -> DataFrame:
    """Results for rows (id, v, cell) on both sides; without ``cells`` all rows are in one."""
    blocks = query_blocks(queries, QUERY_BLOCK)
    if cells:
        counts = blocks.select("cell", "blocks").distinct()
        asked = packs(corpus.join(counts.select("cell"), "cell", "left_semi")).join(counts, "cell")
        numbered, keys = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), ["cell", "block"]
        met = numbered.select(*keys, "ids", "data").join(blocks.select(*keys, "query_ids", "queries"), keys)
    elif (blocks.agg(F.max("blocks")).first()[0] or 0) <= 1:
        met = packs(corpus).join(blocks.select("cell", "query_ids", "queries"), "cell")
    else:
        dealt, number = numbered_packs(corpus)
        spread = blocks.select("query_ids", "queries", F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("pack"))
        met = spread.join(dealt, "pack")
    return top_k(met.mapInPandas(_best_of_pack(k, skip_self), "query_id bigint, id bigint, distance double"), k)


def similar(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    key: str = "id",
    vector: str = "embedding",
    query_key: str | None = None,
    query_vector: str | None = None,
    skip_self: bool = False,
) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest corpus rows of every query, exactly.

    Filter the corpus first (brand, category, price) to search within a part of it.
    """
    one = F.lit(0).alias("cell")
    rows = corpus.select(F.col(key).alias("id"), F.col(vector).alias("v"), one)
    asking = queries.select(F.col(query_key or key).alias("id"), F.col(query_vector or vector).alias("v"), one)
    return _search(rows, asking, k, skip_self, cells=False)


@dataclass(frozen=True)
class CellIndex:
    """A corpus split into cells around centroids, stored by cell."""

    path: str
    centroids: np.ndarray

    def read(self, spark) -> DataFrame:
        return spark.read.parquet(self.path)


def build_index(
    corpus: DataFrame,
    path: str,
    cells: int | None = None,
    key: str = "id",
    vector: str = "embedding",
    seed: int = 7,
    rounds: int = 10,
) -> CellIndex:
    """Place centroids with k-means over all vectors, assign every vector, write them by cell.

    The number of cells is the root of the number of vectors unless given, and at most
    ``MOST_CELLS``: the centroids travel to every task. Larger corpora are searched by
    codes (``vector_codes``). Rebalancing lets several tasks write a crowded cell.
    """
    rows = corpus.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(F.col("v").isNotNull())
    total = rows.count()
    wanted = min(MOST_CELLS, cells or round(total**0.5))
    features = rows.select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    model = KMeans(k=max(1, min(wanted, total)), seed=seed, maxIter=rounds, featuresCol="features").fit(features)
    centroids = unit(np.array(model.clusterCenters()))

    @F.pandas_udf("int")
    def nearest_cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            data = unit(_stack(batch)) if len(batch) else np.empty((0, 0))
            cells = [np.argmax(data[cut] @ centroids.T, axis=1) for cut in slices(len(data), len(centroids))]
            yield pd.Series(np.concatenate(cells) if cells else [], dtype="int32")

    assigned = rows.withColumn("cell", nearest_cell("v"))
    assigned.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(path)
    return CellIndex(path, centroids)


def similar_ann(
    index: CellIndex,
    queries: DataFrame,
    k: int,
    probes: int = 4,
    query_key: str = "id",
    query_vector: str = "embedding",
    skip_self: bool = False,
) -> DataFrame:
    """As ``similar``, looking only into the ``probes`` cells nearest to each query."""
    centroids = index.centroids

    @F.pandas_udf("array<int>")
    def nearest_cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            # Of a slice at once, as a query's cells take more room than its vector.
            for cut in slices(len(vectors), len(centroids)):
                order = np.argsort(-(unit(_stack(vectors.iloc[cut])) @ centroids.T), axis=1)[:, :probes]
                yield pd.Series(list(order.astype(np.int32)), dtype=object)

    asking = queries.select(F.col(query_key).alias("id"), F.col(query_vector).alias("v")).where(F.col("v").isNotNull())
    asking = asking.withColumn("cell", F.explode(nearest_cells("v")))
    stored = index.read(queries.sparkSession).select("id", "v", "cell")
    return _search(stored, asking, k, skip_self, cells=True)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found."""
    hits = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
