"""Two-band rasters as cell tables.

A raster arrives as a long table (row, col, <band>...), row 0 at the top.
Axes follow NumPy ``linspace(bound, bound, n)`` - edge-aligned, not cell
centred, latitude running top -> bottom - and cells get ascending-position
indices so the nearest-cell join (J2) applies unchanged.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linspace_axis(start: float, stop: float, n: int) -> list[float]:
    """NumPy linspace values (driver-side, one grid dimension)."""
    return [float(x) for x in np.linspace(start, stop, n)]


def raster_cells(raster: DataFrame, left: float, right: float, top: float, bottom: float,
                 width: int, height: int, bands) -> tuple[DataFrame, list[float], list[float]]:
    """(cells, lat_values, lon_values): cells carry lat_idx / lon_idx as
    positions in ascending coordinate order, plus lat / lon and the bands."""
    def value(start: float, stop: float, i, n: int):
        step = (stop - start) / (n - 1) if n > 1 else 0.0
        return F.when(i == n - 1, F.lit(float(stop if n > 1 else start))).otherwise(i * F.lit(step) + F.lit(float(start)))

    row = F.col("row").cast("int")
    cells = raster.select(
        (F.lit(height - 1) - row if top > bottom else row).alias("lat_idx"), F.col("col").cast("int").alias("lon_idx"),
        value(top, bottom, F.col("row"), height).alias("lat"), value(left, right, F.col("col"), width).alias("lon"),
        *[F.col(b).cast("double").alias(b) for b in bands])
    return cells, sorted(linspace_axis(top, bottom, height)), linspace_axis(left, right, width)


def surface_to_raster(surface: DataFrame, n_lat: int, bands) -> DataFrame:
    """A per-cell surface (lat_idx ascending) as raster rows, row 0 at the top."""
    return surface.select((F.lit(n_lat - 1) - F.col("lat_idx")).alias("row"), F.col("lon_idx").alias("col"),
                          *[F.col(b) for b in bands])
