"""Sessions as native streaming state: session windows that close when the watermark has passed them.

Spark keeps the open sessions in its state store and merges clicks into them; a session
is written once, when no click within ``late_by`` could still join it. The state holds
the sessions younger than the watermark and nothing else. A click that is so late that
its own session would be closed is left out of the sessions; ``late_clicks`` writes it
to an output of its own. Both run from a checkpoint and go on where they stopped.

A user with a third of all clicks is folded in each task before the clicks are
shuffled, if ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is
set; ``fold_locally`` does so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shopspark.operators.sessions import DEFAULT_GAP_SECONDS
from shopspark.plans.common import any_of, count_rows
from shopspark.streaming.metrics import FLAGS

LATE_BY = "2 days"
#: Groups in which late clicks are looked for; they keep no state.
LATE_GROUPS = 256
FOLD_LOCALLY = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def fold_locally(spark: SparkSession) -> None:
    spark.conf.set(FOLD_LOCALLY, "true")


def closed_sessions(
    clicks: DataFrame, late_by: str = LATE_BY, user: str = "user_id", ts: str = "ts", gap_seconds: int = DEFAULT_GAP_SECONDS
) -> DataFrame:
    """One row per closed session of a stream of clicks; clicks without a user or a time have none."""
    known = clicks.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late_by)
    # Spark joins windows that touch; a click exactly a gap later belongs to the next session.
    window = F.session_window(ts, f"{gap_seconds * 1_000_000 - 1} microseconds").alias("session")
    flags = [any_of(F.col("event_type") == kind).alias(flag) for flag, kind in FLAGS.items()]
    found = known.groupBy(window, user).agg(F.max(ts).alias("last_at"), count_rows("clicks"), *flags)
    return found.select(user, F.col("session.start").alias("started_at"), "last_at", "clicks", *FLAGS)


def late_clicks(
    clicks: DataFrame, late_by: str = LATE_BY, user: str = "user_id", ts: str = "ts", gap_seconds: int = DEFAULT_GAP_SECONDS
) -> DataFrame:
    """The clicks of the stream that ``closed_sessions`` leaves out, with the watermark they missed."""
    known = clicks.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late_by)
    dealt = known.withColumn("_micros", F.unix_micros(ts)).withColumn("_group", F.pmod(F.xxhash64(*clicks.columns), F.lit(LATE_GROUPS)))
    gap = gap_seconds * 1_000_000
    columns = clicks.columns

    def missed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        for frame in frames:
            late = frame[frame["_micros"] + gap - 1 <= mark * 1000]
            if len(late):
                yield late[columns].assign(watermark=pd.to_datetime(mark, unit="ms"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clicks.schema.fields)
    return dealt.groupBy("_group").applyInPandasWithState(
        missed, f"{fields}, watermark timestamp", "unused int", "append", GroupStateTimeout.NoTimeout
    )
