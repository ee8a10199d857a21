"""Registered source and sink queries: round trips of the given tables through
the shared folder (S1, S2, S4-S6, S8, S9, S11, S12, S14-S16, P4, T5, M9)."""
from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import functions as F

from ..config import PROTECTED_COLUMNS, Crop, FeatureParams
from ..operators import metrics, models, nearest, select, temporal
from ..session import materialised, scratch_path
from ..sources import cube as cube_src
from ..sources import store
from ..sources import testdata as td
from . import queries_features as qf
from . import queries_models as qm
from . import queries_scores as qs
from . import suite
from .features import all_null_columns, feature_columns
from .queries_features import finish


STORED = ("srad", "vap")  # the variables of the small feature store


def _folder(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def q_csv_points(spark, sf_dir):
    """Points written as CSV and scanned with the fixed schema."""
    path = _folder(spark, "points")
    pts = td.customer_points(spark, sf_dir).select("ID", "Latitude", "Longitude", "Occurrence Status")
    pts.write.option("header", True).csv(path)
    return finish(store.read_points(spark, path))


def q_cube_scan(spark, sf_dir):
    """The stored cube, cropped by predicates that reach the scan."""
    path = _folder(spark, "cube")
    cube, _ = td.lineitem_cube(spark, sf_dir)
    store.write_table(cube.withColumn("year", F.year("month")), path, ("year",))
    c = qf.CROP
    box = Crop((c["start"], c["end"]), (c["min_lat"], c["max_lat"]), (c["min_lon"], c["max_lon"]))
    return finish(cube_src.read_cube(spark, path, box, ("ppt", "srad", "vap", "pet")))


def _store(spark, sf_dir) -> str:
    """A written feature store: points, their cells and the cells' medians; a
    column without any value is dropped and named in the manifest."""
    root = _folder(spark, "store")
    cube, spec = td.lineitem_cube(spark, sf_dir)
    train = td.customer_points(spark, sf_dir).select("ID", "Latitude", "Longitude", "Occurrence Status")
    test = td.supplier_points(spark, sf_dir).select("ID", "Latitude", "Longitude")
    medians = materialised(temporal.median_surface(cube, STORED).drop("lat", "lon").withColumn("swe_median", F.lit(None).cast("double")), "medians")
    dropped = all_null_columns(medians, ("lat_idx", "lon_idx"))
    medians = medians.drop(*dropped)
    tables = [nearest.nearest_cell_index(t, spec.lat_values, spec.lon_values).join(medians, ["lat_idx", "lon_idx"], "left") for t in (train, test)]
    coords = nearest.distinct_coordinates(train, test)
    for t, name in zip((*tables, coords), ("train_features", "test_features", "pseudo_absence_candidates")):
        store.write_table(t, f"{root}/{name}.parquet")
    bounds = {"min_lat": min(spec.lat_values), "max_lat": max(spec.lat_values), "min_lon": min(spec.lon_values), "max_lon": max(spec.lon_values)}
    config = {"start": spec.start_month, "months": spec.n_time, "bounds": bounds, "spatial_group_size_degrees": FeatureParams().block_degrees}
    columns = feature_columns(tables[0], (*PROTECTED_COLUMNS, "lat_idx", "lon_idx"))
    store.write_json(spark, f"{root}/feature_manifest.json", store.manifest(*tables, coords, coords, config, columns, dropped, spec.variables))
    return root


def q_feature_store(spark, sf_dir):
    """The written store read back; every row says its table."""
    train, test, pseudo, _ = store.read_feature_store(spark, _store(spark, sf_dir))
    cols = ["ID", "Latitude", "Longitude", "lat_idx", "lon_idx"]
    rows = train.select(F.lit("train").alias("part"), *cols).unionByName(test.select(F.lit("test").alias("part"), *cols))
    return finish(rows.unionByName(pseudo.select(F.lit("pseudo").alias("part"), F.lit(None).cast("string").alias("ID"), "Latitude", "Longitude",
                                                 F.lit(None).cast("int").alias("lat_idx"), F.lit(None).cast("int").alias("lon_idx"))))


def q_store_manifest(spark, sf_dir):
    """The manifest's fields as JSON holds them."""
    m = store.read_json(spark, f"{_store(spark, sf_dir)}/feature_manifest.json")
    fields = ("train_rows", "test_rows", "pseudo_absence_candidate_rows", "coordinate_rows", "feature_schema_version", "months", "spatial_group_size_degrees")
    rows = [(f, str(m[f])) for f in fields] + [("start", m["start"])]
    rows += [(f, ",".join(m[f])) for f in ("feature_columns", "variables", "aggregations", "dropped_all_null_columns")]
    rows += [(f, str(v)) for f, v in m["bounds"].items()]
    return spark.createDataFrame(rows, "field string, value string")


def q_store_freshness(spark, sf_dir):
    """A complete store is fresh; one with an older schema version, or
    with a table whose writer did not finish, is not."""
    root = _store(spark, sf_dir)
    rows = [("complete", store.artifacts_fresh(spark, root), spark.read.parquet(f"{root}/train_features.parquet").count())]
    m = store.read_json(spark, f"{root}/feature_manifest.json")
    store.write_json(spark, f"{root}/feature_manifest.json", {**m, "feature_schema_version": 0})
    rows.append(("old version", store.artifacts_fresh(spark, root), int(m["train_rows"])))
    other = _folder(spark, "unfinished")
    spark.read.parquet(f"{root}/test_features.parquet").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false") \
        .parquet(f"{other}/train_features.parquet")
    rows.append(("unfinished", store.artifacts_fresh(spark, other), int(m["test_rows"])))
    return spark.createDataFrame(rows, "state string, fresh boolean, n_rows long")


def q_probability_artifacts(spark, sf_dir):
    """Predictions written by split and candidate, read by their names."""
    root = _folder(spark, "probabilities")
    store.write_predictions(td.score_predictions(spark, sf_dir).select("candidate", "split", "row_id", "y", "p"), root)
    return finish(store.read_probability_artifacts(spark, root).select("candidate", "split", "row_id", "y", "p"))


def q_materialised_table(spark, sf_dir):
    """The second request of a configuration reads what the first wrote."""
    root, built = _folder(spark, "cache"), []

    def build():
        built.append(1)
        return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))

    for config in ({"table": "orders", "by": "status"}, {"by": "status", "table": "orders"}):
        out = store.materialize(spark, build, config, root)
    return out.withColumn("builds", F.lit(len(built)))


def q_run_report(spark, sf_dir):
    """The candidates as one nested record, best first."""
    report = store.run_report(qs._best(spark, sf_dir))
    return finish(report.select(F.posexplode("models").alias("rank", "m")).select("rank", "m.candidate", "m.oof_f1", "m.threshold"))


def q_resumed_run(spark, sf_dir):
    """The best candidate of a saved summary, without running again."""
    out = _folder(spark, "summary")
    best = qs._best(spark, sf_dir).orderBy(F.col("oof_f1").desc(), "candidate").first()
    store.write_json(spark, f"{out}/baseline_summary.json", {"best_model_name": best["candidate"], "best_threshold": best["threshold"],
                                                             "best_oof_f1": best["oof_f1"]})
    r = suite.resume_or_run(spark, out, lambda: 1 / 0)
    return finish(spark.createDataFrame([(r["best_model_name"], r["threshold"], r["oof_f1"])], "candidate string, threshold double, oof_f1 double"))


def q_ranked_candidates(spark, sf_dir):
    """Candidates with held-out and test rows, cut before or after."""
    preds = qs._preds(spark, sf_dir).where(~((F.col("candidate") == "m3") & (F.col("split") == "test")))
    recs = qs._best(spark, sf_dir).join(preds.select("candidate", "build_order").distinct(), "candidate")
    rows = [(mode, i, name) for mode in ("before", "after")
            for i, name in enumerate(select.ranked_available(recs, preds, 5, slice_first=mode == "before"))]
    return spark.createDataFrame(rows, "cut string, rank int, candidate string")


def q_diverse_backfill(spark, sf_dir):
    """T5 with a limit that rejects most candidates, so that back-filling in
    rank order shows: the choice for every k."""
    limit = 0.03
    wide = qs.written_scores(spark, sf_dir)
    corr = metrics.correlations(wide.where("split = 'oof'"), qs.NAMES)
    ranked = qs.ranked_names(wide)
    rows = [(k, i, n) for k in (2, 4, 8) for i, n in enumerate(metrics.select_diverse(ranked, corr, k, limit))]
    return spark.createDataFrame(rows, "k int, place int, candidate string")


def q_cv_structure(spark, sf_dir):
    """M9's rows: every training point once with its held-out fold, every test
    point once, all probabilities in [0, 1]."""
    tr, ts, feats, _ = qm._model_tables(spark, sf_dir)
    preds = models.set_predictions("logistic_regression", models.registry(qm.MC)["logistic_regression"], models.fold_sets(tr, ts, feats, qm.K))
    return preds.select("candidate", "split", "row_id", "y", "fold", F.col("p").between(0, 1).alias("in_range"))


def q_pair_names(spark, sf_dir):
    """All pairs and triples of the candidates that the table holds."""
    names = sorted(r[0] for r in qs._preds(spark, sf_dir).select("candidate").distinct().collect())
    rows = [(len(c), "__".join(c)) for n in (2, 3) for c in combinations(names, n)]
    return spark.createDataFrame(rows, "size int, members string")


QUERIES = {
    "csv_points": q_csv_points, "cube_scan": q_cube_scan, "feature_store": q_feature_store, "store_manifest": q_store_manifest,
    "store_freshness": q_store_freshness, "probability_artifacts": q_probability_artifacts, "materialised_table": q_materialised_table,
    "run_report": q_run_report, "resumed_run": q_resumed_run, "ranked_candidates": q_ranked_candidates,
    "diverse_backfill": q_diverse_backfill, "cv_structure": q_cv_structure, "candidate_sets": q_pair_names,
}
