"""Feature build (lifecycle 3.1): cube -> cell features -> sampled points.

Plan shape: one exchange of the cube on the cell feeds one aggregate with all
temporal statistics and bio indices. Focal statistics run two narrow window
passes over the per-cell medians. Points are mapped to cells by nearest-cell
lookup and joined on the cell key.
"""
from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (CANDIDATE_SUFFIXES, PROTECTED_COLUMNS, CubeSpec, FeatureParams)
from ..functions.scalar import spatial_block
from ..operators import focal, nearest, temporal
from ..operators.sampling import hash_order_limit
from ..session import materialised, spread

CELL = ["lat_idx", "lon_idx"]
NULL_SCAN_COLUMNS = 200
BIO_VARIABLES = ("tmax", "tmin", "ppt", "pet", "soil", "vpd", "def", "pdsi")


def month_labels(spec: CubeSpec) -> list[str]:
    d0 = date.fromisoformat(spec.start_month)
    out = []
    for k in range(spec.n_time):
        y, m = divmod(d0.month - 1 + k, 12)
        out.append(f"{d0.year + y:04d}_{m + 1:02d}")
    return out


def prepared_cube(cube: DataFrame) -> DataFrame:
    """The cube written once, sorted by cell, for plans in which several jobs
    read it; a single reader takes the cube as it is."""
    return materialised(cube.repartition(*CELL).sortWithinPartitions(*CELL, "time_idx"), "cube")


def cell_statistics(cube: DataFrame, spec: CubeSpec, cfg: FeatureParams, variables=None) -> DataFrame:
    """All per-cell features but the focal ones: one exchange of the cube and
    one aggregate. A variable or bio input that the cube lacks is an error."""
    variables = list(variables or spec.variables)
    missing = [v for v in (*variables, *BIO_VARIABLES) if v not in cube.columns]
    if missing:
        raise ValueError(f"the cube has no {', '.join(missing)}")
    return temporal.cell_reduce(cube, variables, cfg, spec.n_time, True)


def cell_features(cube: DataFrame, spec: CubeSpec, cfg: FeatureParams,
                  variables=None) -> DataFrame:
    """All per-cell features: 27 per variable + 30 bio.

    The temporal features are written once (they feed the focal centring, both
    focal passes and the final join), then two narrow focal window passes run
    over the medians."""
    variables = list(variables or spec.variables)
    cells = materialised(cell_statistics(cube, spec, cfg, variables), "cells")
    surface = cells.select(*CELL, *[f"{v}_median" for v in variables])
    loc = focal.focal_stats(surface, variables, cfg.focal_widths)
    out = cells.join(loc, CELL)
    # reorder: per variable, stats then focal then cv (reference order), then bio
    ordered = [*CELL, "lat", "lon"]
    q = [temporal.quantile_name(x) for x in cfg.temporal.quantiles]
    for v in variables:
        ordered += [f"{v}_{s}" for s in ("mean", "median", "std", "min", "max", *q, "trend",
                                         f"last{cfg.temporal.recent}_mean", "djf_mean", "mam_mean",
                                         "jja_mean", "son_mean", "seasonal_amp")]
        for k in cfg.focal_widths:
            ordered += [f"{v}_local_{s}_w{k}" for s in ("mean", "std", "range", "contrast")]
        ordered.append(f"{v}_cv")
    ordered += [c for c in cells.columns if c.startswith("bio_")]
    return out.select(*ordered)


def monthly_sequence(cube: DataFrame, spec: CubeSpec, cells: DataFrame | None,
                     variables) -> DataFrame:
    """Per cell, the value of each month plus delta / recent summaries.

    ``cells`` (CELL columns) restricts the cube to sampled cells first
    (semi join), so only cells with points are reshaped. Each cell gathers
    its months into one map keyed by time_idx (one entry per month, so the
    group is bounded by the time axis), and the wide columns are map lookups
    - cheaper than a multi-aggregate pivot. A variable that the cube lacks is
    an error.
    """
    missing = [v for v in variables if v not in cube.columns]
    if missing:
        raise ValueError(f"the cube has no {', '.join(missing)}")
    if cells is not None:
        cube = cube.join(cells.select(*CELL).distinct(), CELL, "left_semi")
    labels = month_labels(spec)
    g = cube.groupBy(*CELL).agg(F.map_from_entries(F.collect_list(
        F.struct("time_idx", F.struct(*variables)))).alias("__m"))
    # wide projections as SQL strings: one JVM round trip per column
    months = g.selectExpr(*CELL, *[f"element_at(__m, {k}).`{v}` AS `{v}_{labels[k]}`"
                                   for v in variables for k in range(spec.n_time)])
    out = [f"`{c}`" for c in months.columns]
    for v in variables:
        cols = [f"`{v}_{lab}`" for lab in labels]
        out.append(f"{cols[-1]} - {cols[0]} AS `{v}_delta_start_end`")
        out.append(f"{_nanmean_sql(cols[-3:])} AS `{v}_recent3_mean`")
        out.append(f"{_nanstd_sql(cols[-6:])} AS `{v}_recent6_std`")
    return months.selectExpr(*out)


def _nanmean_sql(cols) -> str:
    n = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in cols)
    sm = " + ".join(f"coalesce({c}, 0.0D)" for c in cols)
    return f"(CASE WHEN ({n}) > 0 THEN (0.0D + {sm}) / ({n}) END)"


def _nanstd_sql(cols) -> str:
    n = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in cols)
    m = _nanmean_sql(cols)
    ss = " + ".join(f"coalesce(({c} - {m}) * ({c} - {m}), 0.0D)" for c in cols)
    return f"(CASE WHEN ({n}) > 0 THEN sqrt((0.0D + {ss}) / ({n})) END)"


def sampled_coordinates(train: DataFrame, test: DataFrame, cells: DataFrame,
                        cube: DataFrame, spec: CubeSpec, cfg: FeatureParams) -> tuple[DataFrame, DataFrame]:
    """A17 + J2 + W4: one row per distinct coordinate with its cell, and the
    features of the cells that have coordinates. The wide rows are written once
    a cell, not once a coordinate."""
    idx = materialised(nearest.nearest_cell_index(nearest.distinct_coordinates(train, test), spec.lat_values, spec.lon_values), "coordinates")
    own = idx.select(*CELL).distinct()
    wide = cells.drop("lat", "lon").join(own, CELL, "left_semi").join(monthly_sequence(cube, spec, idx, cfg.monthly_variables), CELL, "left")
    return idx, materialised(wide, "sampled")


def all_null_columns(df: DataFrame, protected=PROTECTED_COLUMNS) -> list[str]:
    """Columns NULL in every row.

    One narrow aggregate for each ``NULL_SCAN_COLUMNS`` columns, which scans
    these columns only, so all of them together read the table once."""
    feats = [c for c in df.columns if c not in set(protected)]
    out = []
    for at in range(0, len(feats), NULL_SCAN_COLUMNS):
        own = feats[at:at + NULL_SCAN_COLUMNS]
        found = df.selectExpr(*["max(`" + c.replace("`", "``") + f"` IS NOT NULL) AS c{i}" for i, c in enumerate(own)]).first()
        out += [c for i, c in enumerate(own) if not found[i]]
    return out


def feature_tables(train: DataFrame, test: DataFrame, coordinates: DataFrame, wide: DataFrame,
                   cfg: FeatureParams, drop_null: bool = True):
    """J1 + F2 + P7: points -> their coordinate's cell -> the cell's features,
    plus spatial blocks. Columns that are NULL in every row of both tables are
    those that are NULL in every sampled cell, so only the cells are scanned."""
    keys = ["Latitude", "Longitude"]
    nearest.assert_many_to_one(coordinates, keys)
    nearest.assert_many_to_one(wide, CELL)
    dropped = all_null_columns(wide, CELL) if drop_null else []
    wide = wide.drop(*dropped)

    def table(points: DataFrame) -> DataFrame:
        own = spread(points.join(coordinates, keys, "left"), points.count(), len(wide.columns))
        out = own.join(wide, CELL, "left").drop(*CELL)
        return out.withColumn("spatial_group", spatial_block("Latitude", "Longitude", cfg.block_degrees))

    return table(train), table(test), dropped


def candidate_columns(columns, last_n: int = 6) -> list[str]:
    """P5: bio_* or a per-variable median / seasonal amplitude / cv / last-n mean."""
    suffixes = (*CANDIDATE_SUFFIXES, f"_last{last_n}_mean")
    return [c for c in columns if c.startswith("bio_") or c.endswith(suffixes)]


def pseudo_absence_grid(cells: DataFrame, cfg: FeatureParams,
                        ignore_counts: bool = False) -> DataFrame:
    """R7 = P9 + P5 + P10 + T6: strided cells as pseudo-absence candidates.

    P10 drops rows NULL in every candidate column. Month counts, spells and
    sum-based bio columns are never NULL, so by the reference's semantics no
    cell is dropped; ``ignore_counts`` applies the evidently intended filter.
    T6: with ``grid.cap`` set, that many rows chosen by a seeded hash order.
    """
    k = max(1, int(cfg.grid.stride))
    cols = candidate_columns(cells.columns, cfg.temporal.recent)
    g = cells.where((F.col("lat_idx") % k == 0) & (F.col("lon_idx") % k == 0))
    test_cols = cols
    if ignore_counts:
        test_cols = [c for c in cols if not (c.endswith("_count") or c.endswith("_spell")
                                             or c in ("bio_annual_ppt_total", "bio_water_balance_total",
                                                      f"bio_water_balance_last{cfg.temporal.recent}"))]
    g = g.dropna(how="all", subset=test_cols)
    g = g.select(F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), *cols)
    return g if cfg.grid.cap is None else hash_order_limit(g, ["Latitude", "Longitude"], cfg.grid.cap, cfg.grid.seed)


def feature_columns(df: DataFrame, protected=PROTECTED_COLUMNS) -> list[str]:
    """Every column that is not protected, in table order."""
    return [c for c in df.columns if c not in set(protected)]
