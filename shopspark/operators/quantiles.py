"""N-tiles of a whole table without a single-partition window.

A bucket of ``ntile(k)`` is an interval of the order (value, id). It is enough to
know the k-1 rows at which buckets end; then every row finds its bucket with
plain comparisons, without sort or shuffle.

The boundary rows are found exactly by narrowing: an interval known to hold the
wanted rank is cut into equal cells, the rows per cell are counted (map-side
combined), and the cell holding the rank is cut again. Ties on the value are
resolved the same way on the id. Once a cell holds few rows they are looked at
directly. The driver sees at most ``FAN_OUT`` counts or rows per boundary.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_OUT = 4096


@dataclass
class _Search:
    """Where the boundary of one rank still may lie; ``rank`` counts from 1."""

    value: str
    rank: int
    low: int
    high: int
    rows: int  # rows inside the interval
    tie: int | None = None  # the boundary value once known; then ids are searched

    @property
    def done(self) -> bool:
        return self.tie is not None and self.low == self.high

    @property
    def width(self) -> int:
        return -(-(self.high - self.low + 1) // FAN_OUT)

    @property
    def scope(self) -> tuple:
        return (self.value, self.low, self.high, self.tie)

    def inside(self, id_column: str) -> Column:
        if self.tie is None:
            return F.col(self.value).between(self.low, self.high)
        return (F.col(self.value) == self.tie) & F.col(id_column).between(self.low, self.high)

    def cell(self, id_column: str) -> Column:
        """Number of the cell a row falls into, null outside the interval."""
        offset = F.col(self.value if self.tie is None else id_column) - F.lit(self.low)
        return F.when(self.inside(id_column), F.call_function("div", offset, F.lit(self.width)))


def bucket_ends(total: int, buckets: int) -> list[int]:
    """Rank of the last row of every bucket but the last; early buckets are larger."""
    base, extra = divmod(total, buckets)
    ends = [base * b + min(b, extra) for b in range(1, buckets)]
    return ends


def _narrow(df: DataFrame, searches: list[_Search], id_column: str, ids: tuple[int, int]) -> None:
    """One counting job for all open searches; each moves to the cell of its rank."""
    scopes = list({s.scope: s for s in searches}.values())
    cells = [F.struct(F.lit(i).alias("scope"), s.cell(id_column).alias("cell")) for i, s in enumerate(scopes)]
    counts: dict[int, list[tuple[int, int]]] = {}
    counted = (
        df.select(F.inline(F.array(*cells)))
        .filter(F.col("cell").isNotNull())
        .groupBy("scope", "cell")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    for row in counted.collect():  # at most FAN_OUT cells per scope
        counts.setdefault(row["scope"], []).append((row["cell"], row["rows"]))
    numbers = {s.scope: i for i, s in enumerate(scopes)}
    for search in searches:
        low, width, high = search.low, search.width, search.high
        for cell, rows in sorted(counts[numbers[search.scope]]):
            if search.rank <= rows:
                search.low = low + cell * width
                search.high = min(high, search.low + width - 1)
                search.rows = rows
                break
            search.rank -= rows
        if search.tie is None and search.low == search.high:
            search.tie, (search.low, search.high) = search.low, ids


def _finish(df: DataFrame, searches: list[_Search], id_column: str) -> None:
    """One job that fetches the few rows left in each interval and picks the ranks."""
    scopes = list({s.scope: s for s in searches}.values())
    hits = [
        F.when(s.inside(id_column), F.struct(F.lit(i).alias("scope"), F.col(s.value).cast("bigint").alias("value")))
        for i, s in enumerate(scopes)
    ]
    found = df.select(F.col(id_column).alias("_id"), F.explode(F.array(*hits)).alias("hit")).filter("hit is not null")
    rows: dict[int, list[tuple[int, int]]] = {}
    for row in found.select("hit.scope", "hit.value", "_id").collect():  # at most FAN_OUT rows per scope
        rows.setdefault(row["scope"], []).append((row["value"], row["_id"]))
    numbers = {s.scope: i for i, s in enumerate(scopes)}
    picked = [sorted(rows[numbers[s.scope]])[s.rank - 1] for s in searches]
    for search, (value, key) in zip(searches, picked):
        search.tie, search.low, search.high = value, key, key


def boundaries(
    df: DataFrame, values: list[str], id_column: str, buckets: int
) -> dict[str, list[tuple[int, int]]]:
    """Per value column the (value, id) of the last row of each bucket but the last."""
    columns = [*values, id_column]
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(c).alias(f"min_{c}") for c in columns],
        *[F.max(c).alias(f"max_{c}") for c in columns],
    ).first()
    if not stats["n"]:
        return {v: [] for v in values}
    ends = bucket_ends(stats["n"], buckets)
    ids = (stats[f"min_{id_column}"], stats[f"max_{id_column}"])
    found = {
        v: [_Search(v, r, stats[f"min_{v}"], stats[f"max_{v}"], stats["n"]) for r in ends if r > 0] for v in values
    }
    searches = [s for group in found.values() for s in group]
    for search in searches:
        if search.low == search.high:
            search.tie, (search.low, search.high) = search.low, ids
    while wide := [s for s in searches if not s.done and s.rows > FAN_OUT]:
        _narrow(df, wide, id_column, ids)
    few = [s for s in searches if not s.done]
    if few:
        _finish(df, few, id_column)
    return {v: [(s.tie, s.low) for s in group] for v, group in found.items()}


def with_ntiles(df: DataFrame, tiles: dict[str, str], id_column: str, buckets: int = 5) -> DataFrame:
    """Add ``ntile(buckets)`` columns: {output column: value column}, ascending.

    Values and ids are integers without nulls, the id is unique and breaks ties.
    ``df`` is scanned several times, so pass a stored table.
    """
    cuts = boundaries(df, list(dict.fromkeys(tiles.values())), id_column, buckets)
    # With fewer rows than buckets the first boundaries fall together on rank 1..n.
    out = {}
    for name, value in tiles.items():
        beyond = [
            F.when(
                (F.col(value) > v) | ((F.col(value) == v) & (F.col(id_column) > i)), 1
            ).otherwise(0)
            for v, i in cuts[value]
        ]
        out[name] = (F.lit(1) + reduce(lambda a, b: a + b, beyond, F.lit(0))).cast("int")
    return df.withColumns(out)
