import logging

from conftest import rows

from shopspark.operators.integrity import ForeignKey, keep_valid, mark_drops, orphan_report, orphans, warn_orphans


def items(spark):
    return spark.createDataFrame(
        [(1, 1, 1), (2, 999, 1), (3, 1, 999), (4, 999, 999), (5, None, 1), (6, 2, 2)], "id int, order_id int, user_id int"
    )


def keys(spark):
    return [
        ForeignKey("order_id", spark.createDataFrame([(1,), (2,)], "order_id int"), "order_id"),
        ForeignKey("user_id", spark.createDataFrame([(1,), (2,)], "id int")),
    ]


def test_semi_and_anti_split_the_input(spark):
    df, fk = items(spark), keys(spark)[0]
    assert rows(keep_valid(df, [fk]).select("id")) == [(1,), (3,), (6,)]
    assert rows(orphans(df, fk).select("id")) == [(2,), (4,), (5,)]


def test_chain_keeps_rows_with_every_reference(spark):
    assert rows(keep_valid(items(spark), keys(spark)).select("id")) == [(1,), (6,)]


def test_drops_are_attributed_to_the_first_broken_key(spark):
    got = {r["id"]: r["dropped_by"] for r in mark_drops(items(spark), keys(spark)).collect()}
    assert got == {1: None, 2: "order_id", 3: "user_id", 4: "order_id", 5: "order_id", 6: None}


def test_report_and_warning(spark, caplog):
    df, fk = items(spark), keys(spark)
    assert {tuple(r) for r in orphan_report(df, fk).collect()} == {
        ("order_id", 999, 2), ("order_id", None, 1), ("user_id", 999, 2)
    }
    with caplog.at_level(logging.WARNING):
        assert warn_orphans(df, fk[0], "id") == 3
    assert "order_id: 3 rows" in caplog.text
