import random

import pytest
from conftest import rows

from shopspark.operators.merge import MergeSpec, merge, require_unique, spec_for
from shopspark.schemas import TABLES

KIND = "id int, name string, age int"


def frame(spark, data):
    return spark.createDataFrame(data, KIND)


def test_insert_update_unchanged_keep(spark):
    target = frame(spark, [(1, "a", 1), (2, "b", 2), (3, None, 3)])
    source = frame(spark, [(1, "a", 1), (2, "c", 2), (4, "d", None)])
    assert {tuple(r) for r in merge(target, source).collect()} == {
        (1, "a", 1, "unchanged"), (2, "c", 2, "update"), (3, None, 3, "keep"), (4, "d", None, "insert")
    }


def test_nulls_compare_as_values(spark):
    target, source = frame(spark, [(1, None, 1), (2, "b", None)]), frame(spark, [(1, None, 1), (2, None, None)])
    assert {r["id"]: r["_action"] for r in merge(target, source).collect()} == {1: "unchanged", 2: "update"}


def test_frozen_columns_keep_the_stored_value_but_take_the_first(spark):
    target, source = frame(spark, [(1, "a", 1)]), frame(spark, [(1, "z", 2), (2, "n", 3)])
    assert {tuple(r) for r in merge(target, source, MergeSpec(frozen=("name",))).collect()} == {
        (1, "a", 2, "update"), (2, "n", 3, "insert")
    }
    frozen_only = frame(spark, [(1, "z", 1)])
    assert merge(target, frozen_only, MergeSpec(frozen=("name",))).collect()[0]["_action"] == "unchanged"


def test_insert_only_without_updatable_columns(spark):
    target, source = frame(spark, [(1, "a", 1)]), frame(spark, [(1, "z", 9), (2, "n", 3)])
    assert rows(merge(target, source, MergeSpec(frozen=("name", "age")))) == [(1, "a", 1, "keep"), (2, "n", 3, "insert")]


def test_column_subset(spark):
    target, source = frame(spark, [(1, "a", 1)]), frame(spark, [(1, "z", 9), (2, "n", 3)])
    assert {tuple(r) for r in merge(target, source, MergeSpec(columns=("id", "age"))).collect()} == {
        (1, "a", 9, "update"), (2, None, 3, "insert")
    }
    with pytest.raises(ValueError, match="missing"):
        merge(target, source, MergeSpec(columns=("id", "other")))


def test_null_keys_never_match(spark):
    target, source = frame(spark, [(None, "a", 1)]), frame(spark, [(None, "b", 2)])
    assert sorted(r["_action"] for r in merge(target, source).collect()) == ["insert", "keep"]


def test_repeated_keys_are_refused(spark):
    with pytest.raises(ValueError, match="repeats"):
        require_unique(frame(spark, [(1, "a", 1), (1, "b", 1)]), ["id"])
    require_unique(frame(spark, [(None, "a", 1), (None, "b", 1), (2, "c", 1)]), ["id"])


def test_settings_of_the_table_win():
    mine = MergeSpec(keys=("uuid",))
    assert spec_for("t", {"t": mine}) is mine
    assert spec_for("t", {}).keys == ("id",)
    assert spec_for("orders", TABLES).keys == ("order_id",)
    assert spec_for("events", TABLES).keys == ("id", "created_at")


def test_merge_equals_a_dictionary_merge(spark):
    rng = random.Random(5)
    for _ in range(3):
        old = {i: (rng.choice(["a", "b", None]), rng.choice([1, 2, None])) for i in rng.sample(range(30), 15)}
        new = {i: (rng.choice(["a", "b", None]), rng.choice([1, 2, None])) for i in rng.sample(range(30), 15)}
        want = {}
        for i in old.keys() | new.keys():
            if i not in new:
                want[i] = (*old[i], "keep")
            elif i not in old:
                want[i] = (*new[i], "insert")
            else:
                want[i] = (*new[i], "unchanged" if old[i] == new[i] else "update")
        flat = lambda d: [(k, *v) for k, v in d.items()]
        got = {r[0]: tuple(r)[1:] for r in merge(frame(spark, flat(old)), frame(spark, flat(new))).collect()}
        assert got == want
        again = merge(merge(frame(spark, flat(old)), frame(spark, flat(new))).drop("_action"), frame(spark, flat(new)))
        assert {r["_action"] for r in again.collect()} <= {"keep", "unchanged"}
