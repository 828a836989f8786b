"""What a load writes, shuffles and leaves on disk, and that it loads the same rows."""

import os
import time
from datetime import datetime

import pytest
from conftest import rows

from shopspark import domain
from shopspark.operators import integrity
from shopspark.operators.contracts import Contract, ContractViolation
from shopspark.operators.integrity import ForeignKey, mark_drops, mark_missing, missing_references
from shopspark.plans.load import load_all, load_table, open_table, stored_table
from shopspark.sources.monthly import MonthlyTable
from shopspark.sources.raw import STAR_SCHEMAS
from shopspark.storage import SPARING, scratch_path, shared_dir, sparing_disk, step_scratch

AS_OF = datetime(2002, 1, 1)


def day(n):
    return datetime(1995, 1 + n % 12, 1 + n % 28)


def written(spark, root, heads=()):
    """A small shop with lines without keys, lines that come twice, and orders without lines."""
    line = lambda order, part, number, n: (order, part, 1, number, float(n % 9), 100.0 + n, 0.05, 0.02, "RNA"[n % 3], "O", day(n))
    lines = [line(o, (o + n) % 6, n, o + n) for o in range(1, 60) for n in range(o % 4)]
    lines += [lines[0], lines[0], line(None, 1, 1, 3), line(3, None, 9, 4), line(999, 1, 1, 5)]
    given = {
        "region": [(0, "ASIA")],
        "nation": [(0, "JAPAN", 0)],
        "customer": [(c, f"C{c}", 0, 1.0, "BUILDING") for c in range(8)],
        "supplier": [(s, f"S{s}", 0, 1.0) for s in range(5)],
        "part": [(p, f"P{p}", "B", "T", p, 10.0 + p) for p in range(6)],
        "orders": [(o, o % 8, "FOP"[o % 3], 5.0, day(o), "5-LOW") for o in range(1, 60)] + list(heads),
        "lineitem": lines,
        "events": [(e, datetime(2024, 1, 1 + e % 3, e % 24), e % 4, "view", 1.0, '{"k": 1}') for e in range(50)],
    }
    for name, table in given.items():
        spark.createDataFrame(table, STAR_SCHEMAS[name]).write.parquet(f"{root}/{name}.parquet")
    return root


@pytest.fixture()
def shop(spark, tmp_path):
    return written(spark, f"{tmp_path}/in")


def shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    return {f for d in env.blockManager().diskBlockManager().localDirsString() for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def scratch(spark):
    top = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}".removeprefix("file://")
    return sorted(os.listdir(top)) if os.path.isdir(top) else []


def text(df):
    """Rows as sorted texts, nulls included."""
    return sorted(r[0] or "" for r in df.select(domain.F.to_json(domain.F.struct(*df.columns), {"ignoreNullFields": "false"})).collect())


def test_items_are_derived_once_and_all_tables_are_the_same(spark, tmp_path, monkeypatch):
    shop = written(spark, f"{tmp_path}/odd", [(None, 1, "F", 5.0, day(1), "1-URGENT"), (None, None, None, None, None, None)])
    expected = {t: (domain.RAW[t](spark, shop).dtypes, text(domain.RAW[t](spark, shop))) for t in domain.RAW}
    calls = []
    derive = domain.raw_order_items
    monkeypatch.setattr(domain, "raw_order_items", lambda *given: calls.append(1) or derive(*given))
    raw = domain.raw_tables(spark, shop)
    for _ in range(2):
        for table in domain.RAW:
            assert (raw(table).dtypes, text(raw(table))) == expected[table] and expected[table][1]
    assert len(calls) == 1


def test_load_leaves_no_scratch_and_no_shuffle_files(spark, shop, tmp_path):
    before, parked = shuffle_files(spark), scratch(spark)
    run = load_all(spark, domain.raw_tables(spark, shop), f"{tmp_path}/out", AS_OF, lookback=None)
    left = [name for name in scratch(spark) if name not in parked]
    assert len(left) == 1 and left[0].startswith("raw-items-")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert not any(key in spark.conf.getAll for key in SPARING)
    assert not [name for name in os.listdir(f"{tmp_path}/out") if name.startswith("_waiting")]
    for step in run.steps:
        assert stored_table(spark, f"{tmp_path}/out", step.table).count() == step.rows_out > 0
    again = load_all(spark, domain.raw_tables(spark, shop), f"{tmp_path}/out", AS_OF, lookback=None)
    assert all(s.actions["insert"] == s.actions["update"] == 0 for s in again.steps)


def test_first_batch_is_written_once(spark, shop, tmp_path, monkeypatch):
    monkeypatch.setattr(MonthlyTable, "overwrite", lambda *given: pytest.fail("the staged batch is written again"))
    raw = domain.raw_events(spark, shop)
    assert load_table(spark, raw, "events", str(tmp_path / "out"), AS_OF)["insert"] == 50
    table = open_table(spark, str(tmp_path / "out"), "events")
    assert table.months() == ["2024-01-01"] and table.rows().count() == 50
    with pytest.raises(ValueError, match="has rows"):
        table.publish(table.waiting_place())


def test_every_month_of_a_first_batch_has_its_place(spark, shop, tmp_path):
    raw = domain.raw_events(spark, shop)
    spread = raw.withColumn("created_at", domain.F.expr("created_at + make_interval(0, cast(id % 5 as int))"))
    load_table(spark, spread, "events", str(tmp_path / "out"), AS_OF)
    table = open_table(spark, str(tmp_path / "out"), "events")
    assert table.months() == [f"2024-0{m}-01" for m in range(1, 6)]
    assert rows(table.rows().groupBy("month").count()) == [(f"2024-0{m}-01", 10) for m in range(1, 6)]
    assert [name for name in os.listdir(table.path) if not name.startswith("month=")] == []


def test_a_stopped_publication_leaves_the_newest_months_out(spark, shop, tmp_path, monkeypatch):
    raw = domain.raw_events(spark, shop).withColumn("created_at", domain.F.expr("if(id = 7, null, created_at + make_interval(0, cast(id % 5 as int)))"))
    table = open_table(spark, str(tmp_path), "events")
    place = table.waiting_place()
    table.lay_out(table.aligned(raw), place)
    find, asked = table._fs, []
    def stopping(path):
        asked.append(path)
        if sum(p.startswith(f"{table.path}/month=") for p in asked) > 3:
            raise KeyboardInterrupt
        return find(path)
    monkeypatch.setattr(table, "_fs", stopping)
    with pytest.raises(KeyboardInterrupt):
        table.publish(place)
    monkeypatch.undo()
    assert table.months() == ["2024-01-01", "2024-02-01", "none"]


def test_a_broken_first_batch_leaves_nothing(spark, shop, tmp_path):
    contract = Contract("events", rows={"late": lambda t: t["id"] > 40})
    with pytest.raises(ContractViolation):
        load_table(spark, domain.raw_events(spark, shop), "events", f"{tmp_path}/out", AS_OF, contract=contract)
    assert not open_table(spark, f"{tmp_path}/out", "events").exists()
    assert not os.path.isdir(f"{tmp_path}/out") or os.listdir(f"{tmp_path}/out") == []


def test_missing_ids_mark_the_same_rows(spark, monkeypatch):
    df = spark.createDataFrame(
        [(1, 1, 1), (2, 9, 1), (3, 1, 9), (4, 9, 9), (5, None, 1), (6, 2, None), (6, 2, None), (7, 9, 1), (8, 2, 2)], "id int, a int, b int"
    )
    fks = [ForeignKey("a", spark.createDataFrame([(1,), (2,), (None,)], "a bigint"), "a"), ForeignKey("b", spark.createDataFrame([(1,), (2,)], "id bigint"))]
    missing = missing_references(df, fks)
    assert text(mark_missing(df, missing)) == text(mark_drops(df, fks))
    # Ids of rows that an earlier key drops already are not looked for.
    assert [rows(m.ids) for m in missing] == [[(9,)], [(9,)]]
    monkeypatch.setattr(integrity, "MOST_SENT", 0)
    dealt = mark_missing(df, missing_references(df, fks))
    assert text(dealt) == text(mark_drops(df, fks))
    assert "BroadcastHashJoin" not in dealt._jdf.queryExecution().executedPlan().toString()
    whole = missing_references(df.where("id in (1, 8)"), fks)
    assert [m.ids for m in whole] == [None, None]
    plan = mark_missing(df, whole)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_steps_clean_up_after_a_failure(spark):
    with pytest.raises(RuntimeError):
        with sparing_disk(spark), step_scratch(spark, "step"):
            path = scratch_path(spark, "part").removeprefix("file://")
            spark.range(3).write.parquet(path)
            assert os.path.isdir(path)
            raise RuntimeError
    assert not os.path.isdir(os.path.dirname(path)) and not any(key in spark.conf.getAll for key in SPARING)
    spark.conf.set("spark.sql.parquet.compression.codec", "gzip")
    try:
        with sparing_disk(spark):
            assert spark.conf.get("spark.sql.parquet.compression.codec") == "gzip"
        assert spark.conf.get("spark.sql.parquet.compression.codec") == "gzip"
    finally:
        spark.conf.unset("spark.sql.parquet.compression.codec")
