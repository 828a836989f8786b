import random

from conftest import ts
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopspark.operators.sessions import sessionize

GAP = 3600


def plain_sessions(df):
    """The textbook form: compare with the click before, then a running sum."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    idle = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))
    starts = df.withColumn("n", F.when(idle < GAP * 1_000_000, 0).otherwise(1))
    numbered = starts.withColumn("s", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rank = F.row_number().over(W.partitionBy("user_id", "s").orderBy("ts", "event_id"))
    return numbered.withColumn("r", rank).select("event_id", F.concat_ws("-", "user_id", "s"), "r")


def test_equals_the_textbook_form_with_a_hot_user(spark):
    rng = random.Random(1)
    base = int(ts("2024-01-01").timestamp()) * 1_000_000
    data = [
        (i, base + rng.randrange(0, 40 * GAP) * 1_000_000 + rng.choice([0, 1, 999_999]), 1 if i % 3 else i % 7)
        for i in range(600)
    ]
    df = spark.createDataFrame(data, "event_id bigint, us bigint, user_id bigint").select(
        "event_id", F.timestamp_micros("us").alias("ts"), "user_id"
    )
    got = sessionize(df, gap_seconds=GAP).select("event_id", "session_id", "sequence_number")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain_sessions(df).collect()))


def test_a_gap_of_exactly_the_limit_starts_a_session(spark):
    df = spark.createDataFrame(
        [(1, ts("2024-01-01T00:30:00"), 1), (2, ts("2024-01-01T01:30:00"), 1), (3, ts("2024-01-01T02:29:59"), 1)],
        "event_id bigint, ts timestamp, user_id bigint",
    )
    got = {r["event_id"]: (r["session_id"], r["sequence_number"]) for r in sessionize(df, gap_seconds=GAP).collect()}
    assert got == {1: ("1-1", 1), 2: ("1-2", 1), 3: ("1-2", 2)}


def test_events_without_a_user_stay_without_a_session(spark):
    df = spark.createDataFrame(
        [(1, ts("2024-01-01"), 1), (2, ts("2024-01-01"), None), (3, None, 1)], "event_id bigint, ts timestamp, user_id bigint"
    )
    got = {r["event_id"]: (r["session_id"], r["sequence_number"]) for r in sessionize(df, gap_seconds=GAP).collect()}
    assert got == {1: ("1-1", 1), 2: (None, None), 3: (None, None)}
