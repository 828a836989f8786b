import pytest
from conftest import ts
from pyspark.sql import functions as F

from shopspark.operators.contracts import Contract, ContractViolation, split_by_contract, validate, violations
from shopspark.operators.rulebook import CONTRACTS, contract_with, strict_contract

USERS = "id int, age int, gender string, latitude double, longitude double, created_at timestamp"


def users(spark, *rows):
    return spark.createDataFrame(list(rows), USERS)


def test_rule_book_is_complete():
    assert sum(len(c.rows) for c in CONTRACTS.values()) == 56
    assert sum(len(c.unique) for c in CONTRACTS.values()) == 9
    assert len(strict_contract("users").rows) == len(CONTRACTS["users"].rows) + 2


def test_valid_table_comes_back(spark):
    df = users(spark, (1, 25, "M", 10.0, 1.0, ts("2023-01-01")), (2, 30, "F", -10.0, 1.0, ts("2023-01-01")))
    assert validate(df, CONTRACTS["users"]) is df


def test_broken_contract_names_its_rules(spark):
    df = users(spark, (1, -5, "M", 10.0, 1.0, ts("2023-01-01")), (1, 30, "X", 100.0, 1.0, None))
    with pytest.raises(ContractViolation) as caught:
        validate(df, CONTRACTS["users"])
    assert caught.value.counts == {
        "age_invalid": 1, "gender_invalid": 1, "lat_out_range": 1, "created_missing": 1, "id_duplicated": 1
    }


def test_unknown_conditions_pass(spark):
    df = users(spark, (1, None, None, None, None, ts("2023-01-01")))
    assert validate(df, CONTRACTS["users"]) is df


def test_null_keys_count_as_duplicates(spark):
    df = users(spark, *[(i, 1, "M", 0.0, 0.0, ts("2023-01-01")) for i in (1, 1, 1, 2, None, None)])
    counts = dict(violations(df, CONTRACTS["users"]).collect())
    assert counts["id_duplicated"] == 4 and counts["id_missing"] == 2


def test_names_are_unique_regardless_of_case(spark):
    df = spark.sql("select * from values (1,'Rio',0D,0D),(2,'RIO',0D,0D) t(id,name,latitude,longitude)")
    assert dict(violations(df, CONTRACTS["distribution_centers"]).collect())["name_duplicates"] == 1


def test_composite_key(spark):
    df = spark.sql(
        "select id, created_at, 's' session_id, 'home' event_type, 1 sequence_number from values "
        "(1, timestamp'2023-01-01'), (1, timestamp'2023-01-02'), (1, timestamp'2023-01-02'), (2, null) t(id, created_at)"
    )
    assert dict(violations(df, CONTRACTS["events"]).collect())["pk_duplicated"] == 2


def test_empty_table_passes_and_empty_contract_fails(spark):
    df = users(spark)
    assert validate(df, CONTRACTS["users"]) is df
    with pytest.raises(ValueError):
        validate(df, Contract("users"))


def test_user_rules_and_totals(spark):
    df = users(spark, (1, 25, "M", 1.0, 1.0, ts("2023-01-01")), (2, 90, "F", 1.0, 1.0, ts("2023-01-01")))
    extra = contract_with("users", {"too_old": lambda t: t["age"] > 80})
    assert dict(violations(df, extra).collect())["too_old"] == 1
    totals = Contract("users", totals={"rows_over_one": lambda t: F.count(F.lit(1)) - 1})
    assert violations(df, totals).collect() == [("rows_over_one", 1)]


def test_split_is_complete(spark):
    df = users(spark, (1, -1, "Q", 1.0, 1.0, ts("2023-01-01")), (2, 3, "F", 1.0, 1.0, ts("2023-01-01")))
    good, bad = split_by_contract(df, CONTRACTS["users"])
    assert [r["id"] for r in good.collect()] == [2]
    assert [(r["id"], r["failed_rules"]) for r in bad.collect()] == [(1, ["age_invalid", "gender_invalid"])]
