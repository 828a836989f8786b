"""Choosing the rows of an incremental load."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def high_watermark(target: DataFrame | None, column: str = "created_at") -> datetime | None:
    """Latest loaded time; None when the target is missing or empty."""
    if target is None:
        return None
    micros = target.agg(F.unix_micros(F.max(column)).alias("micros")).first()["micros"]
    return None if micros is None else datetime(1970, 1, 1) + timedelta(microseconds=micros)


def _instant(moment: datetime):
    """A UTC literal that does not depend on the zone of the Python process."""
    text = moment.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.expr(f"TIMESTAMP '{text}+00:00'")


def newer_than(
    df: DataFrame,
    watermark: datetime | None,
    column: str = "created_at",
    lateness: timedelta = timedelta(0),
) -> DataFrame:
    """Rows strictly after the watermark; everything when there is none.

    ``lateness`` reaches back behind the watermark for late rows; the keyed
    merge makes reading them again harmless.
    """
    if watermark is None:
        return df
    return df.filter(F.col(column) > _instant(watermark - lateness))


def within_lookback(
    df: DataFrame,
    as_of: datetime,
    days: int | None = 180,
    column: str = "created_at",
) -> DataFrame:
    """Rows created at most ``days`` before ``as_of``; None keeps all."""
    if days is None:
        return df
    return df.filter(F.col(column) >= _instant(as_of - timedelta(days=days)))
