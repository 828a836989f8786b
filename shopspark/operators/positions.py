"""The place of each row in an ordered result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopspark.storage import materialize

# Fixed value: row ids count from 0 in each partition, whose number is above these bits.
ROW_BITS = 33


def with_positions(ordered: DataFrame, output: str = "position") -> DataFrame:
    """Number the rows of a sorted result from 1, in its order, nulls and ties included.

    The result is written once with its rows' numbers inside their partitions. Only
    the sizes of the partitions, one row each, are summed up in one task. An empty
    result stays empty. ``output`` must not be a column of the result.
    """
    if output in ordered.columns:
        raise ValueError(f"{output} is a column of the result")
    whole = ordered.select(F.struct(*[F.col(f"`{c}`") for c in ordered.columns]).alias("row"), F.monotonically_increasing_id().alias("at"))
    whole = whole.select("row", F.shiftright("at", ROW_BITS).alias("part"), F.col("at").bitwiseAND((1 << ROW_BITS) - 1).alias("at"))
    stored = materialize(whole, "positions")
    sizes = stored.groupBy("part").agg(F.count("*").alias("rows"))
    before = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    met = stored.join(before, "part").withColumn("at", F.col("before") + F.col("at") + 1)
    return met.select("row", F.col("at").alias("_at")).select("row.*", F.col("_at").alias(output))


def with_places(ordered: DataFrame, keys: Sequence[str], output: str = "place") -> DataFrame:
    """Give the rows of a sorted result the first position of those with equal keys.

    ``keys`` are the columns that the result is sorted by; equal ones must follow
    each other. Keys are combined on the map side before they meet the rows again,
    so a key that a third of the rows share is one row per task in the shuffle.
    Nulls are equal to each other.
    """
    numbered = materialize(with_positions(ordered, "_position"), "places")
    firsts = numbered.groupBy(*[F.col(f"`{k}`").alias(f"_key{n}") for n, k in enumerate(keys)])
    firsts = firsts.agg(F.min("_position").alias(output))
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_key{n}")) for n, k in enumerate(keys)]
    return numbered.join(firsts, same).select(*[F.col(f"`{c}`") for c in ordered.columns], output)
