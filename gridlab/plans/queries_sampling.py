"""Registered queries: nearest neighbours, bagging, pseudo-absences,
imputation, dedup, summaries, and the events series."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ModelParams
from ..operators import describe as dsc
from ..operators import geo, nearest, split, temporal
from ..operators.knn import nearest_distance
from ..operators.sampling import hash_order_limit, negative_bags
from ..session import materialised, spread
from ..sources import testdata as td
from . import features as fplan
from . import pseudo_absence as pa
from .queries_features import CFG, finish

MC = ModelParams()
CELL = ["lat_idx", "lon_idx"]


def q_nn_feature_distance(spark, sf_dir):
    pos, cands = td.embedding_vectors(spark, sf_dir)
    return finish(nearest_distance(cands, pos, "vec_id", "features", "features", "vec_id"))


def _cells(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return (li.select((F.col("l_suppkey") / 10).cast("int").cast("double").alias("Latitude"),
                      F.pmod(F.col("l_suppkey"), F.lit(10)).cast("double").alias("Longitude")).distinct()
            .withColumn("cid", F.concat_ws("_", F.col("Latitude").cast("string"), F.col("Longitude").cast("string"))))


def q_nn_geo_buffer(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    pts = td.customer_points(spark, sf_dir).where(F.col("Occurrence Status") == 1)
    out = cells.join(geo.nearest(cells, pts, MC.background.buffer, "cid"), "cid").drop("cid")
    buf = MC.background.buffer
    anyb = out.agg(F.max((F.col("dist") >= buf).cast("int"))).first()[0] or 0
    return finish(out.withColumn("buffered", F.lit(anyb == 0) | (F.col("dist") >= buf))
                  .withColumnRenamed("dist", "geo_dist"))


def _rows_with_folds(spark, sf_dir):
    rows = td.score_rows(spark, sf_dir).where(F.col("split") == "oof")
    folds = split.group_folds(rows, "grp", "y", MC.folds, MC.seed)
    return split.assign_folds(rows, folds, "grp")


def q_negative_bag(spark, sf_dir):
    rows = _rows_with_folds(spark, sf_dir)
    return negative_bags(rows.select("row_id", "y", "fold"), MC.folds, MC.bagging.bags,
                         MC.bagging.fraction, MC.seed)


def q_negative_bag_share(spark, sf_dir):
    """R3 with fewer negatives than the fold has (F10 rounds their number)."""
    rows = _rows_with_folds(spark, sf_dir)
    return negative_bags(rows.select("row_id", "y", "fold"), MC.folds, 2, 0.35, MC.seed)


def q_hash_cap(spark, sf_dir):
    """A cap below the row count, filled in seeded hash order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return hash_order_limit(orders, ["o_orderkey", "o_custkey"], 700, MC.seed)


BROADCAST_VALUES = 4_000_000  # of the cells that points lie in


def with_cells(points, rows: int, cells, keys=CELL):
    """``points`` (``rows`` rows with the cells' ``keys``) with the features of their cells.
    Only the cells that points lie in are joined; few of them are broadcast, so
    that a cell of many points is no hot key."""
    own = materialised(cells.drop("lat", "lon").join(points.select(*keys).distinct(), keys, "left_semi"), "own-cells")
    width = len(own.columns)
    few = own.count() * width <= BROADCAST_VALUES
    return spread(points, rows, width).join(F.broadcast(own) if few else own, keys, "left").drop(*keys)


def point_features(spark, sf_dir, rounded: bool = False, written: bool = False):
    """Customer points with the statistics and bio indices of their nearest
    cell and spatial-group folds. ``rounded``: to the grid of the oracle.
    ``written``: the cells are written first, for callers that read them and
    the points' features; otherwise a caller that reads a few columns computes
    only these. Folds depend on the points alone."""
    cube, spec = td.lineitem_cube(spark, sf_dir)
    cells = fplan.cell_statistics(cube, spec, CFG)
    cells = finish(cells) if rounded else cells
    cells = materialised(cells, "cells") if written else cells
    pts = td.customer_points(spark, sf_dir)
    idx = nearest.nearest_cell_index(pts, spec.lat_values, spec.lon_values)
    from ..functions.scalar import spatial_block
    rows = idx.withColumn("spatial_group", spatial_block("Latitude", "Longitude", 0.5)) \
        .withColumn("y", F.col("Occurrence Status"))
    folds = split.group_folds(rows, "spatial_group", "y", MC.folds, MC.seed)
    rows = split.assign_folds(rows, folds, "spatial_group")
    if written:
        rows = materialised(rows, "points")
        out = with_cells(rows, rows.count(), cells)
    else:
        out = rows.join(cells.drop("lat", "lon"), CELL, "left").drop(*CELL)
    feats = [c for c in cells.columns if c not in (*CELL, "lat", "lon")]
    return out.select("spatial_group", "ID", "Latitude", "Longitude", "Occurrence Status", *feats, "y", "fold"), cells, spec


def q_pseudo_absence_select(spark, sf_dir):
    train, cells, _ = point_features(spark, sf_dir, rounded=True, written=True)
    env = pa.environmental_columns([c for c in cells.columns if c not in (*CELL, "lat", "lon")])
    cands = (cells.where((F.col("lat_idx") % 2 == 0) & (F.col("lon_idx") % 2 == 0))
             .select(F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), *env))
    return finish(pa.select_pseudo_absences(train, cands, env, MC, MC.folds, MC.background.bags))


IMPUTE_COLS = ["ppt", "srad", "vap", "pet"]
TRAIN_BEFORE = "2000-01-01"


def q_impute_scale(spark, sf_dir):
    cube, _ = td.lineitem_cube(spark, sf_dir)
    base = cube.select("lat_idx", "lon_idx", "time_idx", "month", *IMPUTE_COLS)
    params = dsc.fit_median_minmax(base.where(F.col("month") < F.to_date(F.lit(TRAIN_BEFORE))), IMPUTE_COLS)
    return finish(dsc.apply_median_minmax(base, params).drop("month"))


def q_dedup_keep_first(spark, sf_dir):
    train, _, _ = point_features(spark, sf_dir)
    t = train.select("ID", F.col("srad_median"), F.col("vap_median"), F.col("Occurrence Status"))
    return finish(dsc.dedup_keep_first(t, ["srad_median", "vap_median", "Occurrence Status"], "ID"))


def q_describe_table(spark, sf_dir):
    cube, _ = td.lineitem_cube(spark, sf_dir)
    surf = temporal.median_surface(cube, ["srad", "vap", "ppt"])
    return finish(dsc.describe(surf, ["srad_median", "vap_median", "ppt_median"]))


def q_events_spells(spark, sf_dir):
    """W3 + W2 on a second axis: per user, the longest run of active days
    and the largest complete 3-day total."""
    cube, _ = td.events_cube(spark, sf_dir)
    sp = temporal.longest_spell(cube, F.col("value") > 0, "longest_active_run")
    rq = temporal.rolling_quarter(cube, "value", 3).select(*CELL, "value_wettest_sum")
    return finish(sp.join(rq, CELL).withColumnRenamed("lon_idx", "user_id").drop("lat_idx"))


QUERIES = {
    "nn_feature_distance": q_nn_feature_distance,
    "nn_geo_buffer": q_nn_geo_buffer,
    "negative_bag": q_negative_bag,
    "negative_bag_share": q_negative_bag_share,
    "hash_cap": q_hash_cap,
    "pseudo_absence_select": q_pseudo_absence_select,
    "impute_scale": q_impute_scale,
    "dedup_keep_first": q_dedup_keep_first,
    "describe_table": q_describe_table,
    "events_spells": q_events_spells,
}
