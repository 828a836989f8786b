"""Metrics kept up to date by change rows instead of full passes.

A merge can hand out what it changed: the new version of each inserted or updated row
with sign +1 and the stored version of each updated one with -1. Sums are linear, so the
signed sums of the changes are added to the stored ones; a day without items left is
dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopspark.operators.merge import ACTION, INSERT, UPDATE, MergeSpec
from shopspark.plans.common import not_cancelled, sold
from shopspark.plans.monthly import MonthlyMerge, changed_rows, overwrite_changed
from shopspark.sources.monthly import MONTH, MonthlyTable
from shopspark.storage import materialize

SIGN = "_sign"


def merge_with_changes(table: MonthlyTable, batch: DataFrame, spec: MergeSpec) -> tuple[MonthlyMerge, DataFrame]:
    """Merge a batch of unique keys; also gives the changed rows with their sign.

    The old versions are read before their months are overwritten.
    """
    changed, actions = changed_rows(table, batch, spec)
    names = table.schema.names
    updated = changed.where(F.col(ACTION) == UPDATE).select(MONTH, *spec.keys)
    old = table.rows().join(updated, [MONTH, *spec.keys], "left_semi")
    signed = changed.select(*names, F.lit(1).alias(SIGN)).unionByName(old.select(*names, F.lit(-1).alias(SIGN)))
    signed = materialize(signed, f"signed-{table.name}")
    if not actions[INSERT] + actions[UPDATE]:
        return MonthlyMerge(actions), signed
    return overwrite_changed(table, changed, actions, spec), signed


def daily_item_sums(items: DataFrame, sign: Column | None = None) -> DataFrame:
    """day, gmv, net_revenue, items: sums by the day of the order; ``sign`` weighs the rows."""
    weight = F.lit(1) if sign is None else sign
    money = lambda wanted: F.coalesce(F.sum(F.when(wanted, weight * F.col("sale_price"))), F.lit(0)).cast("decimal(20,2)")
    return items.groupBy(F.to_date("created_at").alias("day")).agg(
        money(not_cancelled()).alias("gmv"), money(sold()).alias("net_revenue"), F.sum(weight).cast("bigint").alias("items")
    )


def fold_daily(stored: DataFrame, signed: DataFrame) -> DataFrame:
    """The stored sums after the changes."""
    both = stored.unionByName(daily_item_sums(signed, F.col(SIGN)))
    sums = [F.sum(c).cast(stored.schema[c].dataType).alias(c) for c in ("gmv", "net_revenue", "items")]
    return both.groupBy("day").agg(*sums).where(F.col("items") > 0)
