"""Staged boosting, saved ensembles, finalising two runs, post-hoc sinks, and
the cube stored by cell."""
import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gridlab.config import Boosting, ModelParams, ModelSizes, public_grid
from gridlab.operators import models, temporal
from gridlab.plans import finalise, posthoc
from gridlab.sources import cube as cube_src
from gridlab.sources import store


@pytest.fixture(scope="module")
def rows(spark):
    """Rings: no single tree of a small rate can fit them."""
    rng = np.random.RandomState(1)
    x = rng.randn(600, 4)
    y = ((np.hypot(x[:, 0], x[:, 1]) > 1.1) ^ (rng.rand(600) < 0.1)).astype(int)
    return spark.createDataFrame([(i, int(y[i]), i % 3, *map(float, x[i])) for i in range(600)], "row_id int, y int, fold int, a double, b double, c double, d double").coalesce(1).cache()


@pytest.mark.parametrize("preset", ["boosted_trees", "boosted_deep", "boosted_slow"])
def test_full_presets_keep_more_than_one_tree(spark, rows, preset):
    params = ModelParams()
    full = getattr(params.sizes, preset)
    held = F.pmod("row_id", F.lit(10)) == 0
    data = rows.where("row_id < 150").select(array_to_vector(F.array("a", "b", "c", "d")).alias("features"), F.col("y").cast("double").alias("label"),
                                             F.lit(1.0).alias("weight"), held.alias("held")).cache()
    est = models.registry(params)[preset].make(600, 4)
    assert (est.getMaxIter(), est.getMaxDepth(), est.getStepSize()) == (full.rounds, full.depth, full.rate) and full.patience > 1
    fitted = models.staged_boosting(est, data.where("NOT held"), data.where("held"), full.patience)
    trees = fitted.getNumTrees
    assert 1 < trees < full.rounds and len(fitted.treeWeights) == trees == len(fitted.trees)
    loss = fitted.evaluateEachIteration(data.where("held"))
    assert int(np.argmin(loss)) == trees - 1  # the best round is the last that is kept
    assert fitted.getFeaturesCol() == "features" and fitted.numFeatures == 4
    assert fitted.transform(data).where("probability IS NULL").count() == 0


def test_stages_agree_with_one_long_fit(spark, rows):
    data = rows.select(array_to_vector(F.array("a", "b", "c", "d")).alias("features"), F.col("y").cast("double").alias("label"),
                       (F.pmod("row_id", F.lit(5)) == 0).alias("held")).cache()
    est = GBTClassifier(maxIter=20, maxDepth=2, stepSize=0.3, subsamplingRate=0.9, seed=5)
    train, held = data.where("NOT held"), data.where("held")
    loss = est.fit(train).evaluateEachIteration(held)
    cut = models.staged_boosting(est, train, held, patience=20, first=5)
    assert cut.getNumTrees == int(np.argmin(loss)) + 1
    assert np.allclose(cut.evaluateEachIteration(held), loss[:cut.getNumTrees])
    one = models.first_trees(est.fit(train), 1)
    assert one.getNumTrees == 1 and np.allclose(one.evaluateEachIteration(held), loss[:1])


SMALL = ModelParams(folds=3, seeds=(), sizes=ModelSizes(50, Boosting(2, 2, 0.3), Boosting(2, 2, 0.3), Boosting(2, 2, 0.3), 4, 4, 3, (4,), 10))


def test_saved_models_score_as_before_saving(spark, rows, tmp_path):
    feats = ["a", "b", "c", "d"]
    test = rows.where("row_id < 40").select("row_id", *feats)
    # boosted fits draw rows by their order in the table, linear ones do not
    reg = {"logistic_regression": models.registry(SMALL)["logistic_regression"], "short": models.logistic(ModelSizes(logistic_iterations=1))}
    sets = models.fold_sets(rows, test, feats, 3)
    before = {}
    for n, m in reg.items():
        for r in models.set_predictions(n, m, sets).where("split = 'test'").collect():
            before.setdefault(int(r["row_id"]), []).append(r["p"])
    models.save_ensemble(reg, rows, feats, 3, str(tmp_path), 0.37)
    scores, threshold = models.score_ensemble(str(tmp_path), test)
    got = {r["row_id"]: r["p"] for r in scores.collect()}
    assert threshold == 0.37 and len(got) == 40
    assert all(abs(got[i] - np.mean(before[i])) < 1e-9 for i in got)
    with pytest.raises(ValueError, match="c"):
        models.score_ensemble(str(tmp_path), test.drop("c"))
    store.write_json(spark, f"{tmp_path}/ensemble_summary.json", {"selected_model_names": [], "folds": 3, "feature_columns": [], "best_threshold": 0.5})
    with pytest.raises(FileNotFoundError):
        models.score_ensemble(str(tmp_path), test)


def test_the_stack_must_beat_both_and_ties_stay():
    assert finalise.choose(0.6, None, 0.9) == "baseline"
    assert finalise.choose(0.6, 0.7, 0.7) == "neural" and finalise.choose(0.6, 0.7, 0.71) == "combined_stack"
    assert finalise.choose(0.7, 0.7, 0.7) == "baseline" and finalise.choose(0.7, 0.7, None) == "baseline"
    assert finalise.choose(0.8, 0.7, 0.75) == "baseline"


def test_members_are_cut_before_and_after_availability():
    base = {"models": {f"b{i}": {"oof_f1": 0.9 - i / 10} for i in range(6)}}
    neural = {"models": {"ensemble_x": {"oof_f1": 0.99}, **{f"n{i}": {"oof_f1": 0.9 - i / 10} for i in range(6)}}}
    got = finalise.stack_members(base, neural, {"b0", "b2", "b4", "b5"}, {"ensemble_x", "n0", "n2", "n4", "n5"})
    assert got == [("baseline", "b0"), ("baseline", "b2"), ("neural", "n0"), ("neural", "n2"), ("neural", "n4")]
    tied = {"models": {n: {"oof_f1": 0.5} for n in ("z", "a", "m")}}
    assert finalise.stack_members(tied, {"models": {}}, {"a", "m", "z"}, set()) == [("baseline", n) for n in "amz"]


def run_rows(spark, seed, names, noise):
    rng = np.random.RandomState(seed)
    y = np.random.RandomState(0).rand(240) < 0.4
    out = []
    for k, n in enumerate(names):
        p = 1 / (1 + np.exp(-(2.0 * y - 1 + rng.randn(240) * noise[k])))
        out += [(n, "oof", i, int(y[i]), i % 3, float(p[i])) for i in range(200)] + [(n, "test", i, None, None, float(p[i])) for i in range(200, 240)]
    return spark.createDataFrame(out, "candidate string, split string, row_id int, y int, fold int, p double")


@pytest.mark.parametrize("noise, source", [(((3.0, 4.0), (4.0, 4.0, 4.0)), None), (((0.05, 3.0), (5.0, 5.0, 5.0)), "baseline"), (((4.0, 4.0), (0.05, 5.0, 5.0)), "neural")])
def test_two_runs_are_finalised(spark, tmp_path, noise, source):
    a, b = run_rows(spark, 1, ["m0", "m1"], noise[0]), run_rows(spark, 2, ["m0", "k1", "ensemble_all"], noise[1])
    base, out = f"{tmp_path}/base", f"{tmp_path}/out"
    finalise.save_run(spark, f"{tmp_path}/neural", "neural_summary.json", b, SMALL)
    train, test = a.where("candidate = 'm0' AND split = 'oof'").select("row_id", "y", "fold"), a.where("candidate = 'm0' AND split = 'test'").select("row_id")
    made = []
    with pytest.raises(FileNotFoundError):
        finalise.finalise(spark, out, base, f"{tmp_path}/neural", train, test, SMALL)
    report = finalise.finalise(spark, out, base, f"{tmp_path}/neural", train, test, SMALL,
                               run=lambda: made.append(finalise.save_run(spark, base, "baseline_summary.json", a, SMALL)))
    assert len(made) == 1 and store.read_json(spark, f"{out}/final_selection.json") == report
    neural = store.read_json(spark, f"{tmp_path}/neural/neural_summary.json")
    stack = finalise.combined_stack(train, (made[0], store.read_probability_artifacts(spark, f"{base}/models")),
                                    (neural, store.read_probability_artifacts(spark, f"{tmp_path}/neural/models")), SMALL)
    assert stack.members[:2] == sorted(["m0", "m1"], key=lambda n: -made[0]["models"][n]["oof_f1"]) and "ensemble_all" not in stack.members
    assert report["source"] == finalise.choose(made[0]["best_oof_f1"], neural["best_oof_f1"], stack.oof_f1)
    assert report["source"] == (source or "combined_stack")
    sub = {r["ID"]: int(r["Target"]) for r in spark.read.option("header", True).csv(report["submission_path"]).collect()}
    table = {"baseline": a, "neural": b, "combined_stack": stack.predictions}[report["source"]]
    own = {str(r["row_id"]): r["p"] for r in table.where(F.col("candidate") == report["best_model_name"]).where("split = 'test'").collect()}
    assert sub == {i: int(p >= report["best_threshold"]) for i, p in own.items()} and len(sub) == 40
    for path in report["threshold_sweep_paths"][:3]:
        t = float(path.rsplit("=", 1)[1])
        got = {r["ID"]: int(r["Target"]) for r in spark.read.option("header", True).csv(path).collect()}
        assert all(got[i] == int(p >= t) for i, p in own.items() if abs(p - t) > 0.01)


def test_the_second_runs_saved_models_score_the_test_rows(spark, rows, tmp_path):
    feats = ["a", "b", "c", "d"]
    test = rows.where("row_id < 30").select("row_id", *feats)
    names = ["m0"]
    weak = rows.select(F.lit("m0").alias("candidate"), F.lit("oof").alias("split"), "row_id", "y", "fold", F.rand(1).alias("p")).unionByName(
        test.select(F.lit("m0").alias("candidate"), F.lit("test").alias("split"), "row_id", F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("fold"), F.lit(0.1).alias("p")))
    sure = weak.withColumn("p", F.when(F.col("y") == 1, 0.9).otherwise(0.1)).withColumn("candidate", F.lit("net"))
    finalise.save_run(spark, f"{tmp_path}/base", "baseline_summary.json", weak, SMALL)
    finalise.save_run(spark, f"{tmp_path}/net", "neural_summary.json", sure, SMALL)
    reg = models.registry(SMALL)
    models.save_ensemble({"logistic_regression": reg["logistic_regression"]}, rows, feats, 3, f"{tmp_path}/net/ensemble", 0.5)
    report = finalise.finalise(spark, f"{tmp_path}/out", f"{tmp_path}/base", f"{tmp_path}/net", rows.select("row_id", "y", "fold"), test, SMALL)
    assert report["source"] == "neural" and names
    want = {str(r["row_id"]): int(r["p"] >= report["best_threshold"]) for r in models.score_ensemble(f"{tmp_path}/net/ensemble", test)[0].collect()}
    assert {r["ID"]: int(r["Target"]) for r in spark.read.option("header", True).csv(report["submission_path"]).collect()} == want


def test_posthoc_submissions_are_read_back_through_the_manifest(spark, tmp_path):
    names = ["b:0", "cross_b_0.8__n=1"]
    preds = run_rows(spark, 3, names, (0.8, 1.1))
    rows = [(n, k + 1, k, 0.5, 0.7, 0.61, 0.69, 0.6, 0.5) for k, n in enumerate(names)]
    ranked = spark.createDataFrame(rows, "candidate string, rank int, build_order int, " + ", ".join(f"{c} double" for c in posthoc.EVAL_COLS))
    made = posthoc.write_posthoc(ranked, preds, str(tmp_path), SMALL, {"baseline_dir": "x"})
    manifest = store.read_json(spark, f"{tmp_path}/posthoc_generation_manifest.json")
    assert manifest == made and manifest["written_count"] == len(manifest["paths"]) == 2 * len(public_grid(SMALL)) and manifest["baseline_dir"] == "x"
    got = {(r["candidate"], r["label"], r["ID"]): r["Target"] for r in posthoc.read_submissions(spark, manifest).collect()}
    want = {(r["candidate"], f"{t:.2f}", str(r["row_id"])): int(r["p"] >= t) for r in preds.where("split = 'test'").collect() for t in public_grid(SMALL)}
    assert got == want
    near = [t for t in public_grid(SMALL) if abs(t - 0.61) <= 0.04 + 1e-9]
    assert posthoc.read_submissions(spark, manifest, recommended=True).select("label").distinct().count() == len(near)
    assert [r["name"] for r in manifest["candidate_rankings"]] == names


def test_a_cube_stored_by_cell_needs_no_exchange(spark, tmp_path):
    rng = np.random.RandomState(2)
    rows = [(la, lo, t, float(la), float(lo), None if rng.rand() < 0.1 else float(rng.rand())) for la in range(6) for lo in range(7) for t in range(24)]
    plain = spark.createDataFrame(rows, "lat_idx int, lon_idx int, time_idx int, lat double, lon double, v double") \
        .withColumn("month", F.add_months(F.to_date(F.lit("2018-01-01")), F.col("time_idx")))
    stored = cube_src.store_by_cell(plain, f"{tmp_path}/cube", "cube_of_cells", 8)
    again = cube_src.open_by_cell(spark, f"{tmp_path}/cube", "cube_again", 8)

    def results(cube):
        stats = temporal.cell_statistics(cube, ["v"], n_time=24)
        return stats, temporal.rolling_quarter(cube, "v"), temporal.longest_spell(cube, F.col("v") > 0.5)

    for cube in (stored, again):
        for got, want in zip(results(cube), results(plain)):
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Bucketed: true" in plan
            key = lambda r: (r["lat_idx"], r["lon_idx"])
            for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key)):
                assert all(x == y or abs(x - y) < 1e-12 for x, y in zip(a, b) if x is not None or y is not None)
    spark.sql("DROP TABLE cube_of_cells")
    spark.sql("DROP TABLE cube_again")
