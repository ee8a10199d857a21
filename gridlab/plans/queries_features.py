"""Registered feature-half queries over the driver's test tables.

Each query takes (spark, sf_dir) and returns a DataFrame whose double
columns are rounded to 6 decimals (the oracle rounds the same way).
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..config import FeatureParams
from ..operators import focal, nearest, temporal
from ..session import scratch_path
from ..sources import cube as cube_src
from ..sources import testdata as td
from . import features as fplan

CELL = ["lat_idx", "lon_idx"]
GRID = float(2 ** 20)
CFG = FeatureParams(variables=td.CUBE_VARIABLES)
# crop window used by cube_crop (binding axes are integer degrees)
CROP = dict(start="1996-01-01", end="2000-12-01", min_lat=0.0, max_lat=7.5,
            min_lon=2.0, max_lon=8.0)


def finish(df: DataFrame) -> DataFrame:
    """Round doubles to a binary grid of 2**-20 (about 1e-6) with plain IEEE
    arithmetic, floor(x * 2**20 + 0.5) / 2**20. The oracle does the same, bit
    for bit; a binary grid has no ties on short decimal values and no -0.0.

    Built as SQL expression strings (one JVM round trip per column instead of
    several per Column operation), which matters for ~1000-column tables."""
    exprs = []
    for f in df.schema.fields:
        q = "`" + f.name.replace("`", "``") + "`"
        if isinstance(f.dataType, (DoubleType, FloatType)):
            exprs.append(f"floor(CAST({q} AS DOUBLE) * {GRID!r}D + 0.5D) / {GRID!r}D AS {q}")
        else:
            exprs.append(q)
    return df.selectExpr(*exprs)


def _cube(spark, sf_dir):
    return td.lineitem_cube(spark, sf_dir)


def q_cube_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube, _ = _cube(spark, sf_dir)
    return finish(cube_src.crop(cube, CROP["start"], CROP["end"], CROP["min_lat"], CROP["max_lat"],
                                CROP["min_lon"], CROP["max_lon"], ["ppt", "srad", "vap", "pet"]))


def q_temporal_stats(spark, sf_dir):
    cube, spec = _cube(spark, sf_dir)
    return finish(temporal.cell_statistics(cube, spec.variables, ("stats",), CFG.temporal.quantiles))


def q_stored_cube_stats(spark, sf_dir):
    """Statistics over the cube stored by cell, without an exchange of
    its rows."""
    cube, spec = td.lineitem_cube(spark, sf_dir)
    key = uuid.uuid4().hex[:12]
    stored = cube_src.store_by_cell(cube, scratch_path(spark, f"cube-{key}"), f"cube_{key}", buckets=16)
    return finish(temporal.cell_statistics(stored, spec.variables, ("stats",), CFG.temporal.quantiles))


def q_temporal_trend(spark, sf_dir):
    cube, spec = _cube(spark, sf_dir)
    return finish(temporal.cell_statistics(cube, spec.variables, ("trend",), CFG.temporal.quantiles,
                                           CFG.temporal.recent, spec.n_time))


def q_seasonal_stats(spark, sf_dir):
    cube, spec = _cube(spark, sf_dir)
    return finish(temporal.cell_statistics(cube, spec.variables, ("seasonal",)))


def _bio(spark, sf_dir):
    cube, spec = _cube(spark, sf_dir)
    return temporal.bioclim_frame(cube, CFG, spec.n_time)


BIO_SUBSETS = {
    "water_balance": ["bio_annual_ppt_total", "bio_water_balance_total", "bio_water_balance_last6"],
    "climate_ranges": ["bio_mean_diurnal_range", "bio_temp_annual_range", "bio_isothermality_proxy"],
    "rolling_quarter": ["bio_wettest_quarter_ppt", "bio_driest_quarter_ppt", "bio_warmest_quarter_tmax",
                        "bio_coldest_quarter_tmin", "bio_wettest_quarter_soil", "bio_driest_quarter_soil"],
    "event_month_counts": ["bio_ppt_dry_month_count", "bio_ppt_wet_month_count",
                           "bio_soil_low_month_count", "bio_tmax_hot_month_count",
                           "bio_vpd_high_month_count", "bio_water_deficit_month_count",
                           "bio_water_surplus_month_count", "bio_pdsi_drought_month_count",
                           "bio_hot_dry_month_count"],
    "longest_spell": ["bio_ppt_longest_dry_spell", "bio_water_deficit_longest_spell",
                      "bio_pdsi_drought_longest_spell", "bio_hot_dry_longest_spell"],
    "recent_anomaly": ["bio_ppt_recent6_anomaly", "bio_soil_recent6_anomaly", "bio_vpd_recent6_anomaly",
                       "bio_def_recent6_anomaly", "bio_water_balance_recent6_anomaly"],
}


def _bio_query(name):
    def q(spark, sf_dir):
        return finish(_bio(spark, sf_dir).select(*CELL, *BIO_SUBSETS[name]))
    q.__name__ = f"q_{name}"
    return q


def q_bioclim(spark, sf_dir):
    return finish(_bio(spark, sf_dir))


def q_focal_stats(spark, sf_dir):
    cube, spec = _cube(spark, sf_dir)
    surf = temporal.median_surface(cube, spec.variables)
    return finish(focal.focal_stats(surf, spec.variables, CFG.focal_widths))


def q_zonal_mean(spark, sf_dir):
    cube, spec = _cube(spark, sf_dir)
    return finish(cube_src.zonal_mean(cube, spec.variables))


def q_median_surface(spark, sf_dir):
    cube, _ = _cube(spark, sf_dir)
    return finish(temporal.median_surface(cube, ["srad", "vap"]))


def _points(spark, sf_dir):
    return td.customer_points(spark, sf_dir), td.supplier_points(spark, sf_dir)


def q_nearest_cell_join(spark, sf_dir):
    cube, spec = _cube(spark, sf_dir)
    tr, te = _points(spark, sf_dir)
    coords = nearest.distinct_coordinates(tr, te)
    surf = temporal.median_surface(cube, ["srad", "vap"])
    idx = nearest.nearest_cell_index(coords, spec.lat_values, spec.lon_values)
    return finish(idx.join(surf.drop("lat", "lon"), CELL, "left"))


def q_monthly_sequence(spark, sf_dir):
    cube, spec = _cube(spark, sf_dir)
    tr, te = _points(spark, sf_dir)
    coords = nearest.distinct_coordinates(tr, te)
    idx = nearest.nearest_cell_index(coords, spec.lat_values, spec.lon_values)
    mon = fplan.monthly_sequence(cube, spec, idx, CFG.monthly_variables)
    return finish(idx.join(mon, CELL, "left").drop(*CELL))


def build_feature_tables(spark, sf_dir, drop_null=True):
    cube, spec = _cube(spark, sf_dir)
    cube = fplan.prepared_cube(cube)
    tr, te = _points(spark, sf_dir)
    cells = fplan.cell_features(cube, spec, CFG)
    coordinates, wide = fplan.sampled_coordinates(tr, te, cells, cube, spec, CFG)
    return fplan.feature_tables(tr, te, coordinates, wide, CFG, drop_null=drop_null)


def q_feature_table(spark, sf_dir):
    tr, _, _ = build_feature_tables(spark, sf_dir)
    return finish(tr)


def q_cell_features(spark, sf_dir):
    cube, spec = _cube(spark, sf_dir)
    return finish(fplan.cell_features(cube, spec, CFG))


def q_pseudo_absence_grid(spark, sf_dir):
    cube, spec = _cube(spark, sf_dir)
    return finish(fplan.pseudo_absence_grid(fplan.cell_statistics(cube, spec, CFG), CFG))


QUERIES = {
    "cube_crop": q_cube_crop,
    "temporal_stats": q_temporal_stats,
    "stored_cube_stats": q_stored_cube_stats,
    "temporal_trend": q_temporal_trend,
    "seasonal_stats": q_seasonal_stats,
    **{name: _bio_query(name) for name in BIO_SUBSETS},
    "bioclim": q_bioclim,
    "focal_stats": q_focal_stats,
    "zonal_mean": q_zonal_mean,
    "median_surface": q_median_surface,
    "nearest_cell_join": q_nearest_cell_join,
    "monthly_sequence": q_monthly_sequence,
    "cell_features": q_cell_features,
    "feature_table": q_feature_table,
    "pseudo_absence_grid": q_pseudo_absence_grid,
}


def q_feature_manifest(spark, sf_dir):
    """Row counts of the feature build as a one-row table
    (train, test, pseudo-absence candidates, distinct coordinates, columns)."""
    from ..config import FEATURE_SCHEMA_VERSION
    cube, spec = _cube(spark, sf_dir)
    tr, te = _points(spark, sf_dir)
    cells = fplan.cell_statistics(cube, spec, CFG)
    coords = nearest.distinct_coordinates(tr, te)
    pa = fplan.pseudo_absence_grid(cells, CFG)
    focal_columns = 4 * len(CFG.focal_widths) * len(spec.variables)
    n_feat = len([c for c in cells.columns if c not in (*CELL, "lat", "lon")]) + focal_columns
    one = [tr.agg(F.count(F.lit(1)).alias("train_rows")), te.agg(F.count(F.lit(1)).alias("test_rows")),
           pa.agg(F.count(F.lit(1)).alias("pseudo_absence_candidate_rows")),
           coords.agg(F.count(F.lit(1)).alias("coordinate_rows"))]
    row = one[0].withColumn("__k", F.lit(1))
    for o in one[1:]:
        row = row.join(o.withColumn("__k", F.lit(1)), "__k")
    return (row.drop("__k")
            .select("*", F.lit(FEATURE_SCHEMA_VERSION).alias("feature_schema_version"),
                    F.lit(spec.n_time).alias("time_steps"), F.lit(n_feat).alias("cell_feature_columns")))


QUERIES["feature_manifest"] = q_feature_manifest


def q_raster_sample(spark, sf_dir):
    """S13 -> S3 -> J2: the srad / vap median surface exported as a two-band
    raster (row 0 at the top), read back on edge-aligned linspace axes and
    sampled at the training points by nearest cell."""
    from ..sources import raster
    cube, spec = _cube(spark, sf_dir)
    surf = temporal.median_surface(cube, ["srad", "vap"])
    r = raster.surface_to_raster(surf, spec.n_lat, ["srad_median", "vap_median"])
    cells, lats, lons = raster.raster_cells(
        r, left=spec.lon_values[0], right=spec.lon_values[-1], top=spec.lat_values[-1],
        bottom=spec.lat_values[0], width=spec.n_lon, height=spec.n_lat, bands=["srad_median", "vap_median"])
    tr = td.customer_points(spark, sf_dir)
    idx = nearest.nearest_cell_index(tr, lats, lons)
    out = idx.join(cells.drop("lat", "lon"), CELL, "left")
    return finish(out.select("ID", F.col("srad_median").alias("srad"), F.col("vap_median").alias("vap")))


QUERIES["raster_sample"] = q_raster_sample
