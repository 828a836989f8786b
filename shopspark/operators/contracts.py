"""Data contracts: row rules, uniqueness rules and free aggregate rules.

A row rule is a condition that marks a *bad* row; an unknown (null) condition
does not. Row and aggregate rules share one aggregate over the table. Uniqueness
is counted on the key columns alone, so the many rule counters never travel with
every key through the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[DataFrame], Column]


class ContractViolation(ValueError):
    """Raised with the failing rules and their counts."""

    def __init__(self, table: str, counts: dict[str, int]):
        self.table, self.counts = table, counts
        super().__init__(f"{table}: contract broken by {counts}")


@dataclass(frozen=True)
class Contract:
    """``rows`` mark bad rows, ``unique`` name key columns, ``totals`` are aggregates."""

    table: str
    rows: dict[str, Rule] = field(default_factory=dict)
    unique: dict[str, tuple[Rule, ...]] = field(default_factory=dict)
    totals: dict[str, Rule] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*self.rows, *self.totals, *self.unique]

    def extended(self, rows: dict[str, Rule]) -> Contract:
        return Contract(self.table, {**self.rows, **rows}, self.unique, self.totals)


def row_counters(df: DataFrame, contract: Contract, among: Column | None = None) -> list[Column]:
    """One counter per row rule, over the rows ``among``; also usable in ``observe``."""
    counters = []
    for name, rule in contract.rows.items():
        bad = rule(df) if among is None else among & rule(df)
        counters.append(F.count(F.when(bad, 1)).alias(name))
    return counters


def _as_rows(counts: DataFrame) -> DataFrame:
    pairs = [F.struct(F.lit(n).alias("rule"), F.col(n).cast("bigint").alias("violations")) for n in counts.columns]
    return counts.select(F.inline(F.array(*pairs)))


def surplus_keys(df: DataFrame, keys: Sequence[Column], name: str) -> DataFrame:
    """Rows minus distinct keys, where a row with a null key part is surplus."""
    names = [f"_k{i}" for i in range(len(keys))]
    whole = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    per_key = (
        df.select(*[k.alias(n) for k, n in zip(keys, names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    )
    surplus = F.sum(F.col("_n") - F.when(whole, 1).otherwise(0))
    return per_key.agg(F.coalesce(surplus, F.lit(0)).cast("bigint").alias(name))


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """One row (rule, violations) per rule of the contract.

    Row rules and totals are counted in one pass; each uniqueness rule reads its key
    columns once more. The load counts row rules while it writes (``plans.load.stage``).
    """
    if not contract.names:
        raise ValueError(f"{contract.table}: the contract has no rules")
    parts = []
    totals = [F.coalesce(rule(df), F.lit(0)).cast("bigint").alias(n) for n, rule in contract.totals.items()]
    counters = row_counters(df, contract) + totals
    if counters:
        parts.append(_as_rows(df.agg(*counters)))
    for name, keys in contract.unique.items():
        parts.append(_as_rows(surplus_keys(df, [k(df) for k in keys], name)))
    return reduce(DataFrame.unionByName, parts)


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """``df`` itself when it keeps the contract, else ``ContractViolation``."""
    broken = violations(df, contract).filter(F.col("violations") > 0)
    counts = {row["rule"]: row["violations"] for row in broken.collect()}  # one row per rule at most
    if counts:
        raise ContractViolation(contract.table, counts)
    return df


def failed_rules(df: DataFrame, contract: Contract) -> Column:
    """Names of the row rules a row breaks, as an array."""
    marks = [F.when(rule(df), F.lit(name)) for name, rule in contract.rows.items()]
    return F.array_compact(F.array(*marks))


def split_by_contract(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with the rules they break (row rules only)."""
    marked = df.withColumn("failed_rules", failed_rules(df, contract))
    good = marked.filter(F.size("failed_rules") == 0).drop("failed_rules")
    return good, marked.filter(F.size("failed_rules") > 0)
