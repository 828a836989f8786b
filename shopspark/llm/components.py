"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopspark.storage import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of ``links`` (a, b); component is the smallest id reachable.

    Each round points every node at its smallest neighbour, follows the pointers
    to their roots by doubling, and replaces the ends of the links by the roots.
    Links inside a root vanish. Every step is a join or a grouping by id, combined
    on the map side, and is written to the shared folder; only counts reach the
    driver.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-links"
    )
    labels = None
    while edges.count():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = both.groupBy("a").agg(F.min("b").alias("b"))
        roots = materialize(roots.select("a", F.least("a", "b").alias("b")), "cc-roots")
        while True:
            up = roots.select(F.col("a").alias("b"), F.col("b").alias("c"))
            jumped = materialize(roots.join(up, "b").select("a", F.col("c").alias("b"), (F.col("c") < F.col("b")).alias("moved")), "cc-roots")
            roots = jumped.select("a", "b")
            if not jumped.where("moved").limit(1).count():
                break
        if labels is None:
            labels = roots
        else:
            up = roots.select(F.col("a").alias("b"), F.col("b").alias("c"))
            labels = materialize(labels.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b")), "cc-labels")
        near = edges.join(roots.withColumnRenamed("b", "ra"), "a")
        far = near.join(roots.select(F.col("a").alias("b"), F.col("b").alias("rb")), "b")
        edges = materialize(
            far.where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "cc-links"
        )
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels.select(F.col("a").alias("id"), F.col("b").alias("component"))
