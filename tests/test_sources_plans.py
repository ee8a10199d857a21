"""Sources/sinks round trips and plan-level behaviour."""
import os

import numpy as np
from pyspark.sql import functions as F

from gridlab.config import SMALL_MODELS, ModelParams, local_grid
from gridlab.operators import calibrate, select
from gridlab.sources import store


def test_local_grid_overshoot():
    g = local_grid(0.88)
    assert abs(g[0] - 0.76) < 1e-9 and abs(g[-1] - 0.96) < 1e-9   # clipped end overshoots, as in NumPy


def test_json_materialize_freshness(spark, tmp_path):
    root = str(tmp_path)
    store.write_json(spark, f"{root}/doc.json", {"b": 1, "a": [1, 2]})
    assert store.read_json(spark, f"{root}/doc.json") == {"a": [1, 2], "b": 1}
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)
    store.materialize(spark, build, {"k": 1}, f"{root}/cache")
    t = store.materialize(spark, build, {"k": 1}, f"{root}/cache")
    assert t.count() == 3 and len(calls) == 1                     # second call is a cache hit
    mark = next(f for f in os.listdir(f"{root}/cache"))
    os.remove(f"{root}/cache/{mark}/_SUCCESS")                    # as an interrupted write leaves it
    assert store.materialize(spark, build, {"k": 1}, f"{root}/cache").count() == 3 and len(calls) == 2
    assert not store.artifacts_fresh(spark, f"{root}/feat")
    for n in ("train_features", "test_features", "pseudo_absence_candidates"):
        spark.range(1).write.parquet(f"{root}/feat/{n}.parquet")
    store.write_json(spark, f"{root}/feat/feature_manifest.json", {"feature_schema_version": 3})
    assert store.artifacts_fresh(spark, f"{root}/feat")
    tr, te, pa, man = store.read_feature_store(spark, f"{root}/feat")
    assert pa is not None and man["feature_schema_version"] == 3


def test_csv_points_fixed_schema(spark, tmp_path):
    p = tmp_path / "train.csv"
    p.write_text("ID,Latitude,Longitude,Occurrence Status\nID_1,-33.5,145.25,1\nID_2,-34.0,146.0,0\n")
    df = store.read_points(spark, str(p))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string", "double", "double", "int"]
    assert df.count() == 2


def test_threshold_fanout_and_sink(spark, tmp_path):
    t = spark.createDataFrame([("1", 0.3), ("2", 0.7)], "ID string, p double")
    f = select.threshold_fanout(t, {"public": [0.45, 0.65], "local": [0.5]})
    got = {(r.grid, r.label, r.ID): r.Target for r in f.collect()}
    assert got[("public", "0.45", "1")] == 0 and got[("public", "0.65", "2")] == 1
    select.write_fanout(f, str(tmp_path / "sweeps"))
    back = spark.read.option("header", True).csv(str(tmp_path / "sweeps"))
    assert back.count() == 6 and set(back.columns) >= {"ID", "Target", "grid", "label"}


def test_later_candidates_replace_earlier_ones(spark):
    from gridlab.config import ModelParams
    from gridlab.plans.suite import Candidates, Record
    s = Candidates(ModelParams())
    rows = [("c", "oof", str(i), i % 2, None, 0.9 if i % 2 else 0.1) for i in range(20)]
    a = spark.createDataFrame(rows, "candidate string, split string, row_id string, y int, fold int, p double")
    s.add(a, [Record("c", "base")])
    assert s.records["c"].oof_f1 == 1.0
    s.add(a.withColumn("p", F.lit(0.5)), [Record("c", "base")])    # U3: the later record replaces it
    assert s.records["c"].oof_f1 < 1.0 and s.records["c"].order == 0 and s.long(["c"]).where("p = 0.5").count() == 20


def test_training_sets_use_their_own_rows_only(spark):
    """Medians, ranges, deviations and weights of a set are those of its
    training rows; columns without a value there leave."""
    from gridlab.operators import models
    rng = np.random.default_rng(4)
    rows = [(str(i), int(i % 3 == 0), i % 2, float(np.round(rng.normal(), 2)) if i % 5 else None, float(i), None if i % 2 else 1.5 + i, 7.0) for i in range(40)]
    cols = ["a", "b", "only0", "same"]
    train = spark.createDataFrame(rows, "row_id string, y int, fold int, a double, b double, only0 double, same double")
    test = train.limit(3).select("row_id", *cols)
    sets = models.fold_sets(train, test, cols, 2)
    assert sets.width == {0: 3, 1: 4} and sets.rows == {0: 20, 1: 20}  # set 0 trains on fold 1, where only0 is null
    for f in (0, 1):
        own = [r for r in rows if r[2] != f]
        got = {r["row_id"]: r for r in sets.table.where((F.col("set") == f) & (F.col("role") == "train")).collect()}
        keep = [j for j in range(4) if f == 1 or cols[j] != "only0"]
        values = np.array([[np.nan if r[3 + j] is None else r[3 + j] for j in keep] for r in own])
        filled = np.where(np.isnan(values), np.nanmedian(values, axis=0), values)
        lo, hi, sd = filled.min(0), filled.max(0), filled.std(0)
        ones = sum(r[1] for r in own)
        for r, x in zip(own, filled):
            g = got[r[0]]
            assert np.allclose(g["raw"].toArray(), x) and np.allclose(g["ranged"].toArray(), np.where(hi > lo, (x - lo) / np.where(hi > lo, hi - lo, 1), 0))
            assert np.allclose(g["standard"].toArray(), np.where(sd > 1e-9, (x - filled.mean(0)) / np.where(sd > 1e-9, sd, 1), 0), atol=1e-6)
            assert abs(g["weight"] - 20 / (2 * (ones if r[1] else 20 - ones))) < 1e-12
    preds = models.set_predictions("lr", models.logistic(SMALL_MODELS), sets).collect()
    assert len(preds) == 43 and all(0 <= r["p"] <= 1 for r in preds)


def test_saved_pipelines_score_plain_rows_as_the_fits_do(spark, tmp_path):
    from gridlab.operators import models
    rng = np.random.default_rng(5)
    rows = [(str(i), int(rng.random() < 0.4), i % 3, float(rng.normal()), None if i % 4 == 0 else float(i), 2.0) for i in range(60)]
    train = spark.createDataFrame(rows, "row_id string, y int, fold int, a double, b double, c double")
    test = train.where("fold = 0").select("row_id", "a", "b", "c")
    for name in ("logistic_regression", "dense_mlp"):
        model = models.registry(ModelParams(sizes=SMALL_MODELS))[name]
        sets = models.fold_sets(train, test, ["a", "b", "c"], 3)
        paths = models.save_fold_models(model, train, ["a", "b", "c"], 3, f"{tmp_path}/{name}", sets)
        saved = {r["row_id"]: r["p"] for r in models.score_saved(paths, test, name).collect()}
        direct = {r["row_id"]: r["p"] for r in models.set_predictions(name, model, sets).where("split = 'test'").collect()}
        assert saved.keys() == direct.keys() and all(abs(saved[i] - direct[i]) < 1e-6 for i in saved)


def test_ranked_available_slice_orders(spark):
    recs = spark.createDataFrame([("a", 0, 0.9), ("b", 1, 0.8), ("c", 2, 0.7), ("d", 3, 0.6)],
                                 "candidate string, build_order int, oof_f1 double")
    rows = [(c, s) for c in "abcd" for s in ("oof", "test") if not (c == "a" and s == "test")]
    preds = spark.createDataFrame(rows, "candidate string, split string")
    assert select.ranked_available(recs, preds, 2, slice_first=True) == ["b"]
    assert select.ranked_available(recs, preds, 2, slice_first=False) == ["b", "c"]


def test_series_reducer_and_resume(spark, tmp_path):
    import datetime as dt
    import pandas as pd
    from gridlab.operators import temporal
    from gridlab.plans import suite
    rows = [(0, j, t, 0.0, float(j), dt.date(2020, t + 1, 1), float(t * (j + 1))) for j in range(2) for t in range(4)]
    cube = spark.createDataFrame(rows, "lat_idx int, lon_idx int, time_idx int, lat double, lon double, month date, v double")

    def last_minus_first(pdf):
        return pd.DataFrame({"lat_idx": [pdf.lat_idx.iloc[0]], "lon_idx": [pdf.lon_idx.iloc[0]],
                             "d": [pdf.v.iloc[-1] - pdf.v.iloc[0]]})
    out = {r.lon_idx: r.d for r in temporal.apply_series_reducer(
        cube, last_minus_first, "lat_idx int, lon_idx int, d double", ["v"]).collect()}
    assert out == {0: 3.0, 1: 6.0}
    assert suite.load_summary(spark, str(tmp_path)) is None
    store.write_json(spark, f"{tmp_path}/baseline_summary.json",
                     {"best_model_name": "m", "best_threshold": 0.4, "best_oof_f1": 0.7, "models": {}})
    assert suite.resume_or_run(spark, str(tmp_path), lambda: None)["best_model_name"] == "m"
