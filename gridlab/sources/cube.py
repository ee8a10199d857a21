"""Long climate cube scan, crop and dense re-indexing.

A cube is a long table with one row per (cell, month):
``lat_idx INT, lon_idx INT, time_idx INT, lat DOUBLE, lon DOUBLE, month DATE, <var> DOUBLE...``.
Missing values are NULL (NaN and +/-inf become NULL at ingest).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Crop, CubeSpec
from ..functions.scalar import nan_to_null
from ..operators.ordering import global_row_number


def axis_table(df: DataFrame, value_col: str, idx_col: str) -> DataFrame:
    """Distinct axis values with dense 0-based positions, numbered by a
    distributed sort; joined like any table, so an axis may have any length."""
    axis = global_row_number(df.select(value_col).distinct(), [value_col], "__rn")
    return axis.select(value_col, (F.col("__rn") - 1).cast("int").alias(idx_col))


def read_cube(spark: SparkSession, path: str, box: Crop, variables: tuple[str, ...]) -> DataFrame:
    """Scan a long cube stored as Parquet (columns lat, lon, month, vars).

    Time slice and bbox are plain predicates so they reach the Parquet scan
    (and prune ``year`` partitions when the table is partitioned by year). A
    variable that the cube does not have is an error.
    """
    raw = spark.read.parquet(path)
    missing = [v for v in variables if v not in raw.columns]
    if missing:
        raise ValueError(f"the cube at {path} has no {', '.join(missing)}")
    return crop(raw, *box.months, *box.lat, *box.lon, variables)


def crop(cube: DataFrame, start: str, end: str, min_lat: float, max_lat: float,
         min_lon: float, max_lon: float, variables) -> DataFrame:
    """P1 + P2 + P3: inclusive time slice and bbox, projection, dense idx."""
    sel = (cube
           .where(F.col("month").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
           .where(F.col("lat").between(F.lit(min_lat), F.lit(max_lat)))
           .where(F.col("lon").between(F.lit(min_lon), F.lit(max_lon)))
           .select("lat", "lon", "month", *[nan_to_null(v).alias(v) for v in variables]))
    lat_axis = axis_table(sel, "lat", "lat_idx")
    lon_axis = axis_table(sel, "lon", "lon_idx")
    time_axis = axis_table(sel, "month", "time_idx")
    return (sel.join(lat_axis, "lat").join(lon_axis, "lon").join(time_axis, "month")
            .select("lat_idx", "lon_idx", "time_idx", "lat", "lon", "month", *variables))


def densify_rows(spark: SparkSession, spec: CubeSpec) -> DataFrame:
    """All (cell, month) positions of the rectangle as rows with NULL values.

    Generated from ``spark.range`` (no join, no cross product); unioned with
    observed rows before the per-(cell, month) aggregate so gaps become NULL.
    """
    per_cell = spec.n_time
    per_lat = spec.n_lon * spec.n_time
    total = spec.n_lat * per_lat
    ids = spark.range(total)
    return ids.select(
        (F.col("id") / per_lat).cast("int").alias("lat_idx"),
        ((F.col("id") / per_cell).cast("long") % spec.n_lon).cast("int").alias("lon_idx"),
        (F.col("id") % per_cell).cast("int").alias("time_idx"),
    )


def zonal_mean(cube: DataFrame, variables) -> DataFrame:
    """Mean over all cells per time step."""
    return (cube.groupBy("time_idx", "month")
            .agg(*[F.avg(v).alias(f"{v}_zonal_mean") for v in variables]))


CELL_BUCKETS = 64


def _cube_ddl(name: str, schema: str, path: str, buckets: int) -> str:
    where = path.replace("'", "''")
    return (f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (lat_idx, lon_idx) "
            f"SORTED BY (lat_idx, lon_idx, time_idx) INTO {buckets} BUCKETS LOCATION '{where}'")


def store_by_cell(cube: DataFrame, path: str, name: str, buckets: int = CELL_BUCKETS) -> DataFrame:
    """The cube as a table bucketed by cell and sorted by cell and
    time. Whatever works cell by cell on it (aggregates, windows over time)
    reads its bucket and needs no exchange, however often it runs. ``buckets``:
    so many that a bucket fits a task; a cell holds one row per month, so no
    bucket is hot. The rows reach the writer dealt by bucket, so that each
    bucket is one file."""
    rows = cube.repartition(buckets, "lat_idx", "lon_idx")
    rows.write.format("parquet").mode("overwrite").bucketBy(buckets, "lat_idx", "lon_idx") \
        .sortBy("lat_idx", "lon_idx", "time_idx").option("path", path).saveAsTable(name)
    return cube.sparkSession.table(name)


def open_by_cell(spark: SparkSession, path: str, name: str, buckets: int = CELL_BUCKETS) -> DataFrame:
    """A cube that another session stored with as many buckets: the table is
    declared over its files, nothing is copied."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(_cube_ddl(name, schema, path, buckets))
    return spark.table(name)
