"""The load: raw files to merged business tables, in dependency order.

One step per table: choose new rows, clean, drop broken references, stage, check,
merge. The batch is staged once as Parquet; counts and row rules are observed
while it is written, and uniqueness then reads only its key columns. The first batch of a table
kept by month is staged as it will stand there and then only put in its place. Tables with a
history are kept by month and a merge rewrites the months it changes; of the others it
writes the next version. Actions are counted on the way.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shopspark.operators.contracts import Contract, ContractViolation, row_counters, surplus_keys
from shopspark.operators.incremental import high_watermark, newer_than, within_lookback
from shopspark.operators.integrity import ForeignKey, Missing, keep_valid, mark_missing, missing_references, warn_orphans
from shopspark.operators.merge import ACTION, INSERT, UPDATE, MergeSpec, merge, require_unique, spec_for
from shopspark.operators.rulebook import CONTRACTS
from shopspark.operators.transforms import clean
from shopspark.plans.monthly import NOTHING, merge_months, observed_changes
from shopspark.plans.runlog import RunLog, Step
from shopspark.schemas import TABLES
from shopspark.session import size_shuffles
from shopspark.sources.layout import clustered
from shopspark.sources.monthly import MonthlyTable
from shopspark.sources.raw import allow_listed, read_raw
from shopspark.sources.versioned import VersionedTable
from shopspark.storage import remove, scratch_path, sparing_disk, step_scratch

log = logging.getLogger(__name__)

ORDER = ("distribution_centers", "users", "products", "inventory_items", "orders", "order_items", "events")
LOOKBACK_DAYS = 180
# Tables kept by month of their creation, with the columns that get a bloom filter.
MONTHLY: dict[str, tuple[str, ...]] = {
    "inventory_items": ("id",),
    "orders": ("order_id",),
    "order_items": ("id", "order_id"),
    "events": ("id",),
}

# Foreign keys: (column, referenced table, referenced column).
REFERENCES: dict[str, tuple[tuple[str, str, str], ...]] = {
    "products": (("distribution_center_id", "distribution_centers", "id"),),
    "inventory_items": (("product_distribution_center_id", "distribution_centers", "id"),),
    "orders": (("user_id", "users", "id"),),
    "order_items": (
        ("order_id", "orders", "order_id"),
        ("user_id", "users", "id"),
        ("product_id", "products", "id"),
        ("inventory_item_id", "inventory_items", "id"),
    ),
}

@dataclass(frozen=True)
class Staged:
    """Row counts of a staged batch; ``losses`` per foreign key, whose ``missing`` ids are known."""

    rows_in: int
    rows_out: int
    losses: dict[str, int]
    missing: tuple[Missing, ...] = ()


TableReader = Callable[[str], DataFrame]


def foreign_keys(table: str, stored: TableReader) -> list[ForeignKey]:
    """The table's foreign keys against the stored tables; a reading error stops the load."""
    keys = []
    for column, target, target_column in REFERENCES.get(table, ()):
        try:
            keys.append(ForeignKey(column, stored(target), target_column))
        except Exception:
            log.error("%s: cannot read %s to check %s", table, target, column)
            raise
    return keys


def new_rows(
    raw: DataFrame,
    table: str,
    target: DataFrame | None,
    as_of: datetime,
    lookback: int | None = LOOKBACK_DAYS,
) -> DataFrame:
    """The part of a raw table this run looks at."""
    if table == "inventory_items":
        return newer_than(raw, high_watermark(target))
    if table in ("orders", "order_items"):
        return within_lookback(raw, as_of, lookback)
    return raw


def chosen(
    raw: DataFrame, table: str, target: DataFrame | None, as_of: datetime, lookback: int | None = LOOKBACK_DAYS
) -> DataFrame:
    """The rows of this run with the columns of the contract, cleaned."""
    return clean(new_rows(allow_listed(raw, TABLES[table]), table, target, as_of, lookback), table)


def extract(
    raw: DataFrame,
    table: str,
    stored: TableReader,
    target: DataFrame | None = None,
    as_of: datetime | None = None,
    lookback: int | None = LOOKBACK_DAYS,
) -> DataFrame:
    """Chosen, cleaned rows of ``table`` whose foreign keys hold; not validated yet.

    Without matching rows the result is empty and keeps the cleaned types.
    """
    now = as_of or datetime.now(timezone.utc).replace(tzinfo=None)
    return keep_valid(chosen(raw, table, target, now, lookback), foreign_keys(table, stored))


def stage(
    df: DataFrame, contract: Contract, fks: Sequence[ForeignKey] = (), table: MonthlyTable | None = None, place: str = ""
) -> tuple[DataFrame, Staged]:
    """Write the valid rows of a batch to scratch, in one pass, and check its contract.

    Rows in, losses per foreign key and row rules are counted by the tasks that
    write. Uniqueness then reads the key columns of the written batch. The first batch
    of a ``table`` kept by month is written to its waiting ``place`` as it will stand there.
    """
    if not contract.names:
        raise ValueError(f"{contract.table}: the contract has no rules")
    spark, seen = df.sparkSession, Observation()
    path = place if table else scratch_path(spark, f"batch-{contract.table}")
    missing = missing_references(df, fks)
    marked = mark_missing(df, missing)
    kept = F.col("dropped_by").isNull()
    losses = [F.count(F.when(F.col("dropped_by") == fk.label, 1)).alias(f"lost_{fk.label}") for fk in fks]
    counters = row_counters(marked, contract, kept)
    every = F.count(F.lit(1)).alias("_in")
    written = F.count(F.when(kept, 1)).alias("_out")
    valid = marked.observe(seen, every, written, *losses, *counters).filter(kept).drop("dropped_by")
    if table:
        table.lay_out(table.aligned(valid), path)
    else:
        valid.write.parquet(path)

    found = seen.get
    staged = Staged(found["_in"], found["_out"], {fk.label: found[f"lost_{fk.label}"] for fk in fks}, tuple(missing))
    counts = {rule: found[rule] for rule in contract.rows}
    batch = spark.read.schema(df.schema).parquet(path)
    if staged.rows_out:
        doubles = [
            surplus_keys(batch, [k(batch) for k in keys], "n").select(F.lit(rule), "n")
            for rule, keys in contract.unique.items()
        ]
        if doubles:
            counts.update(reduce(DataFrame.unionAll, doubles).collect())  # one row per rule
        if contract.totals:
            totals = batch.agg(*[rule(batch).alias(n) for n, rule in contract.totals.items()]).first()
            counts.update({n: v or 0 for n, v in totals.asDict().items()})
    broken = {rule: n for rule, n in counts.items() if n > 0}
    if broken:
        raise ContractViolation(contract.table, broken)
    return batch, staged


def open_table(spark: SparkSession, target_root: str, name: str) -> VersionedTable | MonthlyTable:
    """The stored form of a business table."""
    spec = TABLES[name]
    if name in MONTHLY:
        return MonthlyTable(spark, target_root, name, spec.schema, sort=spec.order_by, lookup=MONTHLY[name])
    return VersionedTable(spark, target_root, name, spec.schema)


def upsert(table: VersionedTable, batch: DataFrame, spec: MergeSpec, checked: bool = False) -> dict[str, int]:
    """Merge ``batch`` into the stored table; returns rows per action.

    ``checked`` says the batch has rows and its keys are known to be unique. What is
    new or differs is found first, so a batch that changes nothing writes nothing.
    """
    if not checked and batch.isEmpty():
        return dict(NOTHING)
    if not checked:
        require_unique(batch, spec.keys)
    table.create()
    changed, counts = observed_changes(merge(table.read(), batch, spec), table.name)
    if counts[INSERT] or counts[UPDATE]:
        replaced = changed.where(F.col(ACTION) == UPDATE).select(*spec.keys)
        kept = table.read().join(replaced, list(spec.keys), "left_anti")
        table.replace(kept.select(*table.schema.names).unionByName(changed.drop(ACTION)))
    return counts


def load_table(
    spark: SparkSession,
    raw: DataFrame,
    table: str,
    target_root: str,
    as_of: datetime,
    lookback: int | None = LOOKBACK_DAYS,
    contract: Contract | None = None,
    step: Step | None = None,
) -> dict[str, int]:
    """One step of the load; what it parks and shuffles goes with it."""
    with sparing_disk(spark), step_scratch(spark, table):
        return _load_table(spark, raw, table, target_root, as_of, lookback, contract, step or Step(table))


def _load_table(
    spark: SparkSession, raw: DataFrame, table: str, target_root: str, as_of: datetime, lookback: int | None,
    contract: Contract | None, step: Step,
) -> dict[str, int]:
    def opened(name: str) -> VersionedTable | MonthlyTable:
        return open_table(spark, target_root, name)

    target, contract = opened(table), contract or CONTRACTS[table]
    before = target.read() if target.exists() else None
    cleaned = chosen(raw, table, before, as_of, lookback)
    fks = foreign_keys(table, lambda name: opened(name).read())
    if isinstance(target, MonthlyTable) and before is None:
        place = target.waiting_place()
        try:
            _, staged = stage(cleaned, contract, fks, target, place)
            _report(step, cleaned, staged)
            if staged.rows_out:
                target.publish(place)
        finally:
            remove(spark, place)
        step.actions = {**NOTHING, INSERT: staged.rows_out}
    else:
        batch, staged = stage(cleaned, contract, fks)
        _report(step, cleaned, staged)
        spec = spec_for(table, TABLES)
        if not staged.rows_out:
            step.actions = dict(NOTHING)
        elif isinstance(target, MonthlyTable):
            step.actions = merge_months(target, batch, spec, checked=True).actions
        else:
            step.actions = upsert(target, batch, spec, checked=True)
    step.status = "loaded" if step.rows_out else "empty"
    return step.actions


def _report(step: Step, cleaned: DataFrame, staged: Staged) -> None:
    """Counts of a staged batch to the step's log, and a warning with some of the rows left out."""
    step.rows_in, step.rows_out, step.losses = staged.rows_in, staged.rows_out, staged.losses
    if staged.rows_in > staged.rows_out:
        log.warning("%s: rows left out for missing references: %s", step.table, staged.losses)
        marked = mark_missing(cleaned, staged.missing)
        for fk in (m.fk for m in staged.missing if staged.losses.get(m.fk.label)):
            lost = marked.where(F.col("dropped_by") == fk.label)
            warn_orphans(cleaned, fk, show=TABLES[step.table].keys[0], count=staged.losses[fk.label], lost=lost)


def load_all(
    spark: SparkSession,
    source: str | TableReader,
    target_root: str,
    as_of: datetime,
    tables: Iterable[str] = ORDER,
    lookback: int | None = LOOKBACK_DAYS,
    contracts: dict[str, Contract] | None = None,
    run: RunLog | None = None,
) -> RunLog:
    """Load the named tables in dependency order.

    ``source`` is a folder of ``<table>.parquet`` or a function from table name
    to raw rows.
    """
    run = run or RunLog()
    wanted = set(tables)
    unknown = wanted - set(ORDER)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    if callable(source):
        reader = source
    else:
        size_shuffles(spark, source)
        reader = lambda name: read_raw(spark, source, name)
    for table in (t for t in ORDER if t in wanted):
        with run.step(table) as step, sparing_disk(spark):
            contract = (contracts or {}).get(table)
            actions = load_table(spark, reader(table), table, target_root, as_of, lookback, contract, step)
            if actions[INSERT] or actions[UPDATE]:
                finish_layout(spark, target_root, [table])
    return run


def finish_layout(spark: SparkSession, target_root: str, tables: Iterable[str] = ORDER) -> None:
    """After a change: rewrite tables ranged by their hot filter columns, if they have any.

    Monthly tables are laid out while they are written.
    """
    for name in (t for t in tables if t not in MONTHLY and TABLES[t].order_by):
        table = open_table(spark, target_root, name)
        if table.exists():
            table.replace(clustered(table.read(), [*TABLES[name].order_by, *TABLES[name].keys]))


def set_up(spark: SparkSession, target_root: str, tables: Iterable[str] = ORDER) -> None:
    """Create the tables that do not exist yet, empty."""
    for name in tables:
        if name not in MONTHLY:
            open_table(spark, target_root, name).create()


def stored_table(spark: SparkSession, target_root: str, name: str) -> DataFrame:
    """Read back a loaded table."""
    return open_table(spark, target_root, name).read()
