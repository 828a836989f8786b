"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition yields a run of digests. Runs meet in binomial rounds: in
each round ``fan_in`` neighbouring runs are merged, equal digests fold into one
row that keeps the largest identifier and the group's size, and the merged run is
dealt by digest, so no round has a task that holds a whole run. A fold happens
only where the strong digest, a second independent digest and the length agree.
Copies fold on the map side before anything moves; a group with a third of all
rows costs one row a task.

Defined cases: a null text counts as empty, and all empty texts are equal. A null
identifier is smaller than any other. Of repeated rows (equal identifier and
text) one stays. An empty table gives an empty result. Other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopspark.storage import materialize

EVIDENCE = ("digest", "check", "bytes")


def _evidence(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    return {"digest": F.unhex(F.sha2(text, 256)), "check": F.xxhash64(text), "bytes": F.octet_length(text)}


def _merge_round(runs: DataFrame, fan_in: int) -> DataFrame:
    """Merge each ``fan_in`` neighbouring runs; the largest identifier of equal digests stays."""
    return (
        runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        .groupBy("run", *EVIDENCE)
        .agg(F.max("keeper").alias("keeper"), F.sum("members").alias("members"))
    )


def digest_runs(docs: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    """One row per document, sorted by digest within each run, stored once."""
    rows = docs.select(F.col(id_col).alias("id"), F.struct(*[c.alias(n) for n, c in _evidence(F.col(text_col)).items()]).alias("e"))
    rows = rows.select("id", "e.*", F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("run", F.pmod(F.spark_partition_id(), F.lit(runs)).cast("int"))
    return materialize(rows.sortWithinPartitions("digest"), "digest-runs")


def merged_groups(leaves: DataFrame, runs: int, fan_in: int) -> DataFrame:
    """One row per distinct text: the row that stays and the number of its copies."""
    level = leaves.select("run", *EVIDENCE, F.struct("id", "row").alias("keeper"), F.lit(1).cast("long").alias("members"))
    while runs > 1:
        level = _merge_round(level, fan_in)
        runs = -(-runs // fan_in)
    return level.select(*EVIDENCE, "keeper", "members")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 256, fan_in: int = 16
) -> DataFrame:
    """One row per document: ``id_col``, keep_id, group_size, kept, text_sha256."""
    if runs < 2 or fan_in < 2:
        raise ValueError("runs and fan_in must be at least 2")
    leaves = digest_runs(docs, id_col, text_col, runs)
    groups = materialize(merged_groups(leaves, runs, fan_in), "digest-groups")
    linked = leaves.join(groups, list(EVIDENCE))
    return linked.select(
        F.col("id").alias(id_col),
        F.col("keeper.id").alias("keep_id"),
        F.col("members").alias("group_size"),
        (F.col("row") == F.col("keeper.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 256, fan_in: int = 16
) -> DataFrame:
    """The documents that stay, with all their columns."""
    mark = "__identity"
    while mark in docs.columns:
        mark += "_"
    leaves = digest_runs(docs, id_col, text_col, runs)
    groups = merged_groups(leaves, runs, fan_in)

    def identity(key: Column, digest: Column) -> Column:
        return F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("-")), F.hex(digest))

    stay = materialize(groups.select(identity(F.col("keeper.id"), F.col("digest")).alias(mark)), "digest-kept")
    marked = docs.withColumn(mark, identity(F.col(id_col), _evidence(F.col(text_col))["digest"]))
    # Rows repeated as a whole share an identity; the join has brought them together.
    return marked.join(stay, mark, "left_semi").dropDuplicates([mark]).drop(mark)
