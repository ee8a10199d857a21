"""J1 (validated many-to-one equi join), J2 (nearest-cell join), A17/U1.

The nearest-cell join is reduced to an equi join: the index of a point's
nearest coordinate is arithmetic on a regular axis, and a bucket between
sorted midpoints on any other (only then the axis values travel in the plan).
A point exactly on a midpoint goes to the larger coordinate, and points
outside go to the edge cell.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["lat_idx", "lon_idx"]


def _regular_index(x: Column, first: float, step: float, n: int) -> Column:
    """Index of the nearest of first + i * step, by arithmetic; the rounded
    guess is compared with the midpoints on both sides, so it is exact."""
    def middle(i: Column) -> Column:  # between coordinates i - 1 and i
        return (i - 1) * F.lit(step) / 2 + i * F.lit(step) / 2 + F.lit(first)

    guess = F.least(F.greatest(F.floor((x - F.lit(first)) / F.lit(step) + 0.5), F.lit(0)), F.lit(n - 1)).cast("long")
    moved = F.when((guess > 0) & (x < middle(guess)), guess - 1).when((guess < n - 1) & (x >= middle(guess + 1)), guess + 1).otherwise(guess)
    return F.when(x.isNotNull() & ~F.isnan(x), moved.cast("int"))


def _axis_index(df: DataFrame, col: str, values: Sequence[float], out: str) -> DataFrame:
    vals = sorted(float(v) for v in values)
    if len(vals) == 1:
        return df.withColumn(out, F.when(F.col(col).isNotNull(), F.lit(0)))
    step = vals[1] - vals[0]
    if all(v == vals[0] + i * step for i, v in enumerate(vals)):
        return df.withColumn(out, _regular_index(F.col(col).cast("double"), vals[0], step, len(vals)))
    mids = [(a + b) / 2.0 for a, b in zip(vals[:-1], vals[1:])]
    splits = [float("-inf"), *mids, float("inf")]
    tmp = f"__{out}_in"
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=f"__{out}_b", handleInvalid="keep")
    res = b.transform(df.withColumn(tmp, F.col(col).cast("double")))
    nb = len(splits) - 1
    return (res.withColumn(out, F.when(F.col(f"__{out}_b") < nb, F.col(f"__{out}_b").cast("int")))
            .drop(tmp, f"__{out}_b"))


def nearest_cell_index(points: DataFrame, lat_values, lon_values,
                       lat_col: str = "Latitude", lon_col: str = "Longitude") -> DataFrame:
    """Adds ``lat_idx``/``lon_idx`` of the nearest grid coordinate per axis."""
    p = _axis_index(points, lat_col, lat_values, "lat_idx")
    return _axis_index(p, lon_col, lon_values, "lon_idx")


def distinct_coordinates(*frames: DataFrame, lat_col: str = "Latitude",
                         lon_col: str = "Longitude") -> DataFrame:
    """Union of coordinate pairs, deduplicated."""
    u = None
    for f in frames:
        s = f.select(lat_col, lon_col)
        u = s if u is None else u.unionByName(s)
    return u.distinct()


def assert_many_to_one(right: DataFrame, keys: Sequence[str]) -> None:
    """J1 guard: the right side must be unique on ``keys``."""
    dup = right.groupBy(*keys).count().where(F.col("count") > 1).limit(1).count()
    if dup:
        raise ValueError(f"join keys {list(keys)} are not unique on the right side")
