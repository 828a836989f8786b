"""Mix sources to target weights.

Words are summed per source, every source's target gives its repetition rate, and
each document is taken floor(rate) times plus once more with a probability equal
to the fraction, drawn from a hash of its identifier. The hash gives ``DRAWS``
independent draws; a source uses the one whose sum of words over all its
documents comes nearest to its target, so few documents or one long one do not
push a small source off its share.

Only one row per source is ever joined to the documents. Sums are combined on the
map side; a source with a third of all rows is split by adaptive execution or met
by a broadcast of the small table, as Spark measures it.

Defined cases: null text has size 0, a null source is a source of its own and
comes last, a null identifier draws like the empty string. Repeated rows draw
alike. A source of size 0 has target 0 and its documents are not taken. An empty
table gives an empty mix. Other columns are kept by :func:`mix` as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopspark.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
DRAWS = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Number the sources from 0 by code point, null last, without one task for all."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    local = dealt.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
    local = materialize(local, "mix-sources")
    # One row per range partition.
    before = local.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return local.join(before, "part").withColumn("rank", F.col("before") + F.col("at")).drop("part", "at", "before")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources share the total by weight. Where a share would pass ``max_repeat``
    times the source it stops there, and the rest is shared again by weight among
    the others until no share is above its limit.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = materialize(_ranked(totals).withColumn("weight", weight.cast("long")), "mix-weights")
    limit = F.col("source_size") * max_repeat
    capped, found = F.lit(False), -1
    while True:
        # Each round is one sum over the sources; limits once reached stay reached.
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(capped, limit).otherwise(0)).alias("fixed"),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("shares"),
            F.count_if(capped).alias("found"),
        ).first()
        rest, shares = (row["total"] or 0) - (row["fixed"] or 0), row["shares"] or 0
        if row["found"] == found or not shares:
            break
        found = row["found"]
        wide = "decimal(38,0)"
        share = F.lit(rest).cast(wide) * F.col("weight").cast("decimal(10,0)")
        capped = capped | (limit.cast("decimal(27,0)") * F.lit(shares).cast("decimal(10,0)") <= share)
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(max(shares, 1)))
    target = F.when(capped, limit.cast("double")).otherwise(F.least(share, limit.cast("double")))
    return sources.select("source", "source_size", target.alias("target"))


def _draw(key: Column, at: int) -> Column:
    """A number in [0, 1) from eight hexadecimal digits of the identifier's hash."""
    digits = F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256), 8 * at + 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**32))


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT,
) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes, and per source: source_size, target, whole copies, fraction, draw."""
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = materialize(sizes, "mix-sizes")
    targets = source_targets(sizes, weights, max_repeat)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = targets.withColumn("rate", rate)
    rates = rates.withColumn("copies", F.floor("rate").cast("int")).withColumn("fraction", F.col("rate") - F.col("copies"))
    rates = materialize(rates, "mix-rates")
    drawn = sizes.join(rates.select(F.col("source").alias("s"), "fraction"), F.col("source").eqNullSafe(F.col("s")))
    sums = [F.sum(F.when(_draw(F.col("id"), k) < F.col("fraction"), F.col("size")).otherwise(0)) for k in range(DRAWS)]
    sums = drawn.groupBy("source").agg(*[s.alias(f"draw{k}") for k, s in enumerate(sums)])
    sums = sums.withColumnRenamed("source", "s")
    met = rates.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    wanted = F.col("fraction") * F.col("source_size")
    misses = F.array(*[F.abs(F.coalesce(F.col(f"draw{k}"), F.lit(0)) - wanted) for k in range(DRAWS)])
    draw = (F.array_position(misses, F.array_min(misses)) - 1).cast("int")
    plan = met.select("source", "source_size", "target", "copies", "fraction", draw.alias("draw"))
    return sizes, materialize(plan, "mix-plan")


def _copies(key: Column) -> Column:
    digits = F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256), F.col("draw") * 8 + 1, F.lit(8))
    drawn = F.conv(digits, 16, 10).cast("double") / F.lit(float(2**32))
    return F.col("copies") + F.when(drawn < F.col("fraction"), 1).otherwise(0)


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: ``id_col``, size, source_size, target, taken."""
    sizes, plan = plan_mix(docs, id_col, text_col, source_col, **options)
    met = sizes.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return met.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * _copies(F.col("id"))).cast("long").alias("taken")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with all its columns."""
    _, plan = plan_mix(docs, id_col, text_col, source_col, **options)
    # The document travels as one struct, so its columns may have any names.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    met = whole.join(plan, F.col(f"doc.`{source_col}`").eqNullSafe(F.col("source")))
    taken = F.explode(F.array_repeat(F.lit(0), _copies(F.col(f"doc.`{id_col}`"))))
    return met.select("doc", taken.alias("copy")).select("doc.*")
