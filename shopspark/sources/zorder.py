"""Points laid out along a Z-order curve, and circles read as a few ranges of it.

The key interleaves the bits of the row and the column of a fine grid, so points near
each other on the map are mostly near each other in the key. Files are written ranged
and sorted by it, and Parquet's row-group statistics on the key then let a scan skip
what lies elsewhere. A circle's box is cut into quadrants of the grid, each of them one
range of keys; ranges that follow each other are joined, and the closest ones too until
a bounded number is left. The exact distance decides at the end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopspark.operators.radius import geographic_boxes, within_radius

KEY = "z"
#: Bits for each of row and column: cells of 0.0055 degrees of longitude, half of that of latitude.
BITS = 16
RANGES = 24


def _spread_bits(number: Column) -> Column:
    """The lowest ``BITS`` bits of a number with a zero between each two."""
    bits = [F.shiftleft(F.shiftright(number, i).bitwiseAND(F.lit(1)), 2 * i) for i in range(BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def grid_row(latitude: float) -> int:
    return min((1 << BITS) - 1, max(0, math.floor((latitude + 90.0) / 180.0 * (1 << BITS))))


def grid_col(longitude: float) -> int:
    return min((1 << BITS) - 1, max(0, math.floor((longitude + 180.0) / 360.0 * (1 << BITS))))


def z_key(latitude: Column, longitude: Column) -> Column:
    """Place on the curve; null without coordinates. Coordinates off the map count as its border."""
    top = F.lit((1 << BITS) - 1)
    cell = lambda share: F.least(top, F.greatest(F.lit(0), F.floor(share * (1 << BITS)).cast("long")))
    row, col = cell((latitude + 90.0) / 180.0), cell((longitude + 180.0) / 360.0)
    return F.shiftleft(_spread_bits(row.cast("long")), 1).bitwiseOR(_spread_bits(col.cast("long")))


def write_along_curve(points: DataFrame, path: str, tie: Sequence[str] = ("id",), row_group_bytes: int | None = None) -> None:
    """Write points ranged and sorted by their key; ``tie`` splits a place that many points share."""
    keyed = points.withColumn(KEY, z_key(F.col("latitude"), F.col("longitude")))
    writer = keyed.repartitionByRange(KEY, *tie).sortWithinPartitions(KEY, *tie).write
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", max(1024, row_group_bytes // 8))
    writer.parquet(path)


def box_ranges(low_row: int, high_row: int, low_col: int, high_col: int, limit: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of keys (both ends included) that cover the cells of a box, ``limit`` at most."""
    found: list[tuple[int, int]] = []
    # A quadrant is split while it lies across the border of the box and the ranges still allow it.
    open_ = [(0, 0, BITS)]
    while open_:
        split = len(open_) + len(found) < 4 * limit
        following = []
        for row, col, level in open_:
            side = 1 << level
            if row > high_row or row + side - 1 < low_row or col > high_col or col + side - 1 < low_col:
                continue
            inside = row >= low_row and row + side - 1 <= high_row and col >= low_col and col + side - 1 <= high_col
            if inside or level == 0 or not split:
                first = _interleaved(row, col)
                found.append((first, first + (1 << 2 * level) - 1))
            else:
                half = side >> 1
                following += [(row + r, col + c, level - 1) for r in (0, half) for c in (0, half)]
        open_ = following
    return joined(found, limit)


def _interleaved(row: int, col: int) -> int:
    return sum(((row >> i & 1) << 2 * i + 1) | ((col >> i & 1) << 2 * i) for i in range(BITS))


def joined(ranges: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """Sorted ranges; those that touch are one, and the narrowest gaps are closed until ``limit`` are left."""
    ordered = sorted(ranges)
    if not ordered:
        return []
    gaps = sorted(b[0] - a[1] for a, b in zip(ordered, ordered[1:]))
    widest = gaps[len(gaps) - limit] if len(gaps) >= limit else 1
    out = [ordered[0]]
    for low, high in ordered[1:]:
        if low - out[-1][1] <= max(1, widest):
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def circle_ranges(latitude: float, longitude: float, radius_m: float, limit: int = RANGES) -> list[tuple[int, int]]:
    boxes = geographic_boxes(latitude, longitude, radius_m)
    each = max(1, limit // len(boxes))
    ranges = [r for low_lat, high_lat, low_lon, high_lon in boxes
              for r in box_ranges(grid_row(low_lat), grid_row(high_lat), grid_col(low_lon), grid_col(high_lon), each)]
    return joined(ranges, limit)


def read_circle(spark: SparkSession, path: str, latitude: float, longitude: float, radius_m: float) -> DataFrame:
    """Points at most ``radius_m`` from a place, with ``distance_m``, reading only the key ranges of the circle."""
    points = spark.read.parquet(path)
    near = reduce(lambda a, b: a | b, [F.col(KEY).between(low, high) for low, high in circle_ranges(latitude, longitude, radius_m)])
    return within_radius(points.where(near), latitude, longitude, radius_m).drop(KEY)
