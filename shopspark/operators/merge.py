"""Keyed merge of a batch into a table.

Rows are matched by key with a full outer join; each output row says in
``_action`` what happened: insert, update, unchanged or keep.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopspark.schemas import TableSpec

ACTION = "_action"
INSERT, UPDATE, UNCHANGED, KEEP = "insert", "update", "unchanged", "keep"


@dataclass(frozen=True)
class MergeSpec:
    """``keys`` match rows, ``frozen`` columns keep the stored value on a match.

    ``columns`` limits the merge to some source columns; None takes them all.
    """

    keys: tuple[str, ...] = ("id",)
    frozen: tuple[str, ...] = ()
    columns: tuple[str, ...] | None = None


DEFAULT = MergeSpec()


def spec_for(table: str, configured: dict[str, TableSpec | MergeSpec], fallback: MergeSpec = DEFAULT) -> MergeSpec:
    """The table's own settings, or the fallback when it has none."""
    found = configured.get(table)
    if found is None:
        return fallback
    if isinstance(found, MergeSpec):
        return found
    return MergeSpec(keys=found.keys, frozen=found.frozen)


def chosen_columns(source: DataFrame, spec: MergeSpec) -> list[str]:
    """The source columns that a merge takes."""
    columns = list(spec.columns) if spec.columns else list(source.columns)
    absent = [c for c in columns if c not in source.columns]
    if absent:
        raise ValueError(f"configured columns missing from the input: {absent}")
    return columns


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def duplicated_keys(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (null keys match nothing and are left out)."""
    whole = source.filter(_all([F.col(k).isNotNull() for k in keys]))
    return whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > 1)


def require_unique(source: DataFrame, keys: Sequence[str]) -> None:
    sample = duplicated_keys(source, keys).limit(5).collect()
    if sample:
        raise ValueError(f"the batch repeats keys, such as {[tuple(r) for r in sample]}")


def merge(target: DataFrame, source: DataFrame, spec: MergeSpec = DEFAULT) -> DataFrame:
    """All rows of the merged table with their ``_action``.

    Keys must be unique on both sides (``require_unique`` checks a batch). A
    matched row counts as updated only if an updatable column differs, nulls
    compared as values. Without updatable columns only new rows are added.
    """
    columns = chosen_columns(source, spec)
    keys, names = list(spec.keys), list(target.columns)
    updatable = [c for c in columns if c not in keys and c not in spec.frozen]

    incoming = source.select(*columns)
    if not updatable:
        matched = _all([target[k] == incoming[k] for k in keys])
        fresh = incoming.join(target.select(*keys), matched, "left_anti")
        filled = [F.col(c) if c in columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in names]
        return target.withColumn(ACTION, F.lit(KEEP)).unionByName(
            fresh.select(*filled).withColumn(ACTION, F.lit(INSERT))
        )

    old = target.select(*[F.col(c).alias(f"t_{c}") for c in names], F.lit(True).alias("_stored"))
    new = incoming.select(*[F.col(c).alias(f"s_{c}") for c in columns], F.lit(True).alias("_given"))
    joined = old.join(new, _all([F.col(f"t_{k}") == F.col(f"s_{k}") for k in keys]), "full_outer")

    stored, given = F.col("_stored").isNotNull(), F.col("_given").isNotNull()
    differs = reduce(
        lambda a, b: a | b, [~F.equal_null(F.col(f"t_{c}"), F.col(f"s_{c}")) for c in updatable]
    )
    action = (
        F.when(~given, KEEP).when(~stored, INSERT).when(differs, UPDATE).otherwise(UNCHANGED)
    )

    def value(c: str) -> Column:
        if c not in columns:
            return F.col(f"t_{c}")
        if c in updatable:
            return F.when(given, F.col(f"s_{c}")).otherwise(F.col(f"t_{c}"))
        return F.when(stored, F.col(f"t_{c}")).otherwise(F.col(f"s_{c}"))

    return joined.select(
        *[value(c).cast(target.schema[c].dataType).alias(c) for c in names], action.alias(ACTION)
    )
