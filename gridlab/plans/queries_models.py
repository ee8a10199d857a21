"""Registered model queries (rows-only checks: estimators are not SQL).

They fit their models in the sizes of ``SMALL_MODELS``, a documented parameter,
on all feature columns, folds and bags; ``model_suite`` fits the whole registry
in its full sizes.
"""
from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..config import SMALL_MODELS, ModelParams
from ..operators import calibrate, metrics, models, nearest, split
from ..operators.sampling import negative_bags
from ..session import VALUES_PER_TASK, cut_lineage, materialised, scratch_path
from ..sources import store
from ..sources import testdata as td
from . import pseudo_absence as pa
from . import suite
from .queries_features import finish
from .queries_sampling import point_features, with_cells
from .queries_scores import NAMES, diverse

MC = ModelParams(sizes=SMALL_MODELS)
FULL = ModelParams()
K = MC.folds
CELL = ["lat_idx", "lon_idx"]


def _model_tables(spark, sf_dir):
    """Training points (customer) and test points (supplier) with all
    statistics of their cells, the feature columns, and the cells."""
    train, cells, spec = point_features(spark, sf_dir, written=True)
    te = td.supplier_points(spark, sf_dir)
    idx = nearest.nearest_cell_index(te, spec.lat_values, spec.lon_values)
    test = with_cells(idx, idx.count(), cells)
    feats = [c for c in cells.columns if c not in (*CELL, "lat", "lon")]
    tr = materialised(train.select(F.col("ID").alias("row_id"), "y", "fold", F.col("spatial_group").alias("grp"), "Latitude", "Longitude", *feats), "train")
    ts = materialised(test.select(F.col("ID").alias("row_id"), *feats), "test")
    return tr, ts, feats, cells


def _absences(tr, cells, feats):
    """R4-R6 with the features of the chosen cells: fold, bag, ID, y, features;
    of many draws, those of a cell share one row: draws, y, features."""
    stride = 2
    cands = (cells.where((F.col("lat_idx") % stride == 0) & (F.col("lon_idx") % stride == 0))
             .select(F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), *feats))
    sel = pa.select_pseudo_absences(tr.withColumnRenamed("row_id", "ID"), cands, pa.environmental_columns(feats), MC, K, MC.background.bags)
    sel = materialised(sel, "absences")
    rows, at = sel.count(), ["Latitude", "Longitude"]
    if rows * len(feats) <= VALUES_PER_TASK:
        return with_cells(sel, rows, cands, at).select("fold", "bag", "ID", "y", *feats)
    places = places_drawn(sel, rows)
    return with_cells(places, places.count(), cands, at).select("draws", "y", *feats)


DRAWS = 4096  # of a row, on average, at most


def places_drawn(sel, rows: int):
    """Latitude, Longitude, y, draws (array of fold, bag, ID): ``rows`` draws by
    their places, so that wide features are written for each place and not for
    each draw. A place of a few cells' draws is several rows."""
    at = ["Latitude", "Longitude", "y"]
    parts = max(1, -(-rows // (DRAWS * max(1, sel.select(*at).distinct().count()))))
    part = F.pmod(F.xxhash64("ID"), F.lit(parts)).alias("__part")
    return materialised(sel.groupBy(*at, part).agg(F.sort_array(F.collect_list(F.struct("fold", "bag", "ID"))).alias("draws")).drop("__part"), "places")


def _cv(name, params=MC, with_trees=False):
    def q(spark, sf_dir):
        tr, ts, feats, _ = _model_tables(spark, sf_dir)
        return finish(models.set_predictions(name, models.registry(params)[name], models.fold_sets(tr, ts, feats, K), with_trees=with_trees))
    q.__name__ = f"q_cv_{name}"
    return q


def q_cv_metrics(spark, sf_dir):
    """M9: per-fold F1 of the logistic model's held-out folds."""
    tr, ts, feats, _ = _model_tables(spark, sf_dir)
    preds = models.set_predictions("logistic_regression", models.registry(MC)["logistic_regression"], models.fold_sets(tr, ts, feats, K))
    return finish(models.fold_f1(preds))


def q_bagged_cv(spark, sf_dir):
    """Negative-bagged forest, bags averaged within folds."""
    tr, ts, feats, _ = _model_tables(spark, sf_dir)
    draws = negative_bags(tr.select("row_id", "y", "fold"), K, MC.bagging.bags, MC.bagging.fraction, MC.seed)
    sets = models.bag_sets(tr, ts, draws, feats, K, MC.bagging.bags)
    return finish(models.set_predictions("extra_trees_negative_bagged", models.registry(MC)["extra_trees"], sets))


def q_pseudo_cv(spark, sf_dir):
    """Training folds with environmental pseudo-absences, all bags."""
    tr, ts, feats, cells = _model_tables(spark, sf_dir)
    sets = models.background_sets(tr, ts, _absences(tr, cells, feats), feats, K, MC.background.bags)
    return finish(models.set_predictions("extra_trees_pseudo_absence", models.registry(MC)["extra_trees"], sets))


def q_random_split_benchmark(spark, sf_dir):
    """Stratified 70/30 split, median impute + range + logistic on two
    columns; F1 at 0.5 on the validation rows."""
    tr, _, _, _ = _model_tables(spark, sf_dir)
    r = suite.random_split_benchmark(tr, list(suite.BENCHMARK_COLUMNS), MC)
    row = ("benchmark", *[r[c] for c in ("threshold", "tp", "fp", "fn", "f1_at_0_50")])
    return finish(spark.createDataFrame([row], "candidate string, threshold double, tp long, fp long, fn long, f1_at_0_50 double"))


def _score_oof(spark, sf_dir):
    p = td.score_predictions(spark, sf_dir)
    rows = td.score_rows(spark, sf_dir).where("split = 'oof'")
    folds = split.group_folds(rows, "grp", "y", K, MC.seed)
    return p.join(folds.select("grp", "fold"), "grp", "left")


def _stack(spark, sf_dir, members, prefix):
    """Meta-models on the members' columns under the same group folds."""
    p = _score_oof(spark, sf_dir)
    wide = cut_lineage(metrics.wide_predictions(p, members, ("split", "row_id", "y", "fold")))
    sets = models.fold_sets(wide.where("split = 'oof'").drop("split"), wide.where("split = 'test'").drop("split", "y", "fold"), members, K)
    reg = models.registry(MC)
    return [models.set_predictions(f"{prefix}_{n}", reg[n], sets) for n in suite.STACKERS]


def q_stacking(spark, sf_dir):
    """Held-out columns of the diverse candidates as meta-features."""
    outs = _stack(spark, sf_dir, diverse(spark, sf_dir, MC.ensembles.stacked), "stacking")
    return finish(outs[0].unionByName(outs[1]))


def q_combined_stack(spark, sf_dir):
    """Stack over the top 4 'baseline' (m0-m3) and top 3 'neural'
    (m4-m7) candidates; the better meta-model by OOF F1 is kept."""
    from ..config import optimize_grid
    from ..operators import select as sel
    preds = td.score_predictions(spark, sf_dir)
    recs = (metrics.best_threshold(metrics.threshold_sweep(preds.where("split = 'oof'"), optimize_grid(MC)))
            .join(preds.select("candidate", "build_order").distinct(), "candidate"))
    # Baseline top 4 sliced before the availability semi join, neural top 3 after it
    base = sel.ranked_available(recs.where(F.col("candidate").isin(NAMES[:4])), preds, 4, slice_first=True)
    neural = sel.ranked_available(recs.where(F.col("candidate").isin(NAMES[4:])), preds, 3, slice_first=False,
                                  exclude_prefix="ensemble_")
    outs = [cut_lineage(o) for o in _stack(spark, sf_dir, base + neural, "combined_stack")]
    f1 = [metrics.best_threshold(metrics.threshold_sweep(o.where("split = 'oof'"), optimize_grid(MC))).first().oof_f1 for o in outs]
    return finish(outs[0] if f1[0] >= f1[1] else outs[1])


def _calibrated(method, test_mode):
    def q(spark, sf_dir):
        """Cross-fitted calibration of the top candidates."""
        top = diverse(spark, sf_dir, 4)
        p = cut_lineage(_score_oof(spark, sf_dir).where(F.col("candidate").isin(top)))
        return finish(calibrate.cross_fit(p.select("split", "row_id", "y", "fold", "p", "candidate"), [method], K, test_mode))
    q.__name__ = f"q_calibrate_{method}"
    return q


def q_saved_ensemble(spark, sf_dir):
    """Fold pipelines with their imputer and scaler, saved to the shared
    folder, reloaded, averaged over folds on the plain test rows."""
    tr, ts, feats, _ = _model_tables(spark, sf_dir)
    path = scratch_path(spark, f"saved-models-{uuid.uuid4().hex[:12]}")
    paths = models.save_fold_models(models.registry(MC)["logistic_regression"], tr, feats, K, path)
    return finish(models.score_saved(paths, ts, "saved_logistic_regression"))


QUERIES = {
    "cv_logistic": _cv("logistic_regression"),
    "cv_trees": _cv("boosted_trees", with_trees=True),
    "cv_forest": _cv("extra_trees"),
    "cv_mlp": _cv("dense_mlp"),
    "cv_metrics": q_cv_metrics,
    "bagged_cv": q_bagged_cv,
    "pseudo_cv": q_pseudo_cv,
    "random_split_benchmark": q_random_split_benchmark,
    "stacking": q_stacking,
    "combined_stack": q_combined_stack,
    "calibrate_sigmoid": _calibrated("sigmoid", "mean"),
    "calibrate_isotonic": _calibrated("isotonic", "mean"),
    "calibrate_beta": _calibrated("beta", "full"),
    "saved_ensemble": q_saved_ensemble,
}


def q_posthoc_generation(spark, sf_dir):
    """Lifecycle 3.3 over the score binding: baseline family m0-m3, neural
    family m4-m7, calibration folds from R2 on the document source."""
    from ..config import optimize_grid
    from . import posthoc as ph
    from .queries_scores import source_prevalence
    p = materialised(td.score_predictions(spark, sf_dir).select("candidate", "split", "row_id", "y", "grp", "p"), "score-rows", ("candidate",))
    best = {r.candidate: r.oof_f1 for r in metrics.best_threshold(
        metrics.threshold_sweep(p.where("split = 'oof'"), optimize_grid(MC))).collect()}
    order = {n: i for i, n in enumerate(NAMES)}
    rank = lambda ns: sorted(ns, key=lambda n: (-best[n], order[n]))
    rows = p.where((F.col("split") == "oof") & (F.col("candidate") == NAMES[0]))  # each row once
    folds = split.assign_folds(rows, split.group_folds(rows, "grp", "y", K, MC.seed), "grp").select("row_id", "fold")
    ranked, _ = ph.posthoc(p.drop("grp"), rank(NAMES[:4]), rank(NAMES[4:]), materialised(folds, "folds"),
                           source_prevalence(spark, sf_dir), MC)
    return finish(ranked)


QUERIES["posthoc_generation"] = q_posthoc_generation


def q_posthoc_submissions(spark, sf_dir):
    """Submissions of all ranked candidates at all public thresholds
    and their manifest, written and read back through the manifest's paths."""
    from . import posthoc as ph
    from .queries_scores import _eval
    out = scratch_path(spark, f"posthoc-{uuid.uuid4().hex[:12]}")
    ranked = materialised(_eval(spark, sf_dir), "ranked")
    preds = td.score_predictions(spark, sf_dir).select("candidate", "split", "row_id", "y", "p")
    ph.write_posthoc(ranked, preds, out, MC)
    manifest = store.read_json(spark, f"{out}/posthoc_generation_manifest.json")
    every = ph.read_submissions(spark, manifest).groupBy("candidate", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("Target").alias("n_positive"))
    near = ph.read_submissions(spark, manifest, recommended=True).select("candidate", "label").distinct().withColumn("recommended", F.lit(True))
    return every.join(near, ["candidate", "label"], "left").withColumn("recommended", F.coalesce("recommended", F.lit(False)))


QUERIES["posthoc_submissions"] = q_posthoc_submissions


def q_finalise_run(spark, sf_dir):
    """Two saved runs (m0-m3, m4-m7) are finalised: a stack of both
    runs' best models is fitted, the winner's submission and sweeps are written
    and the report is read back."""
    from . import finalise as fin
    p = _score_oof(spark, sf_dir)
    rows = materialised(p.select("candidate", "split", "row_id", "y", "fold", "p"), "score-rows")
    out = scratch_path(spark, f"finalise-{uuid.uuid4().hex[:12]}")
    for summary, own in (("baseline", NAMES[:4]), ("neural", NAMES[4:])):
        fin.save_run(spark, f"{out}/{summary}", f"{summary}_summary.json", rows.where(F.col("candidate").isin(own)), MC)
    train = rows.where((F.col("split") == "oof") & (F.col("candidate") == NAMES[0])).select("row_id", "y", "fold")
    test = rows.where((F.col("split") == "test") & (F.col("candidate") == NAMES[0])).select("row_id")
    fin.finalise(spark, out, f"{out}/baseline", f"{out}/neural", train, test, MC)
    report = store.read_json(spark, f"{out}/final_selection.json")
    submission = spark.read.option("header", True).csv(f"{out}/final_submission").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("Target").cast("int")).alias("n_positive")).first()
    row = (report["source"], report["best_model_name"], report["best_oof_f1"], report["best_threshold"], len(report["threshold_sweep_paths"]),
           submission["n_rows"], submission["n_positive"])
    return finish(spark.createDataFrame([row], "source string, best_model_name string, best_oof_f1 double, best_threshold double, n_sweeps int, n_rows long, n_positive long"))


QUERIES["finalise_run"] = q_finalise_run


def q_saved_models(spark, sf_dir):
    """M15 for several models: a linear and a boosted one on the cells' medians,
    saved fold by fold, read back through their summary and averaged."""
    tr, ts, feats, _ = _model_tables(spark, sf_dir)
    feats = [f for f in feats if f.endswith("_median")]
    out = scratch_path(spark, f"ensemble-{uuid.uuid4().hex[:12]}")
    reg = models.registry(MC)
    models.save_ensemble({n: reg[n] for n in ("logistic_regression", "boosted_trees")}, tr, feats, K, out, 0.5)
    scores, threshold = models.score_ensemble(out, ts)
    return scores.select("row_id", F.col("p").between(0, 1).alias("in_range"), F.lit(threshold).alias("threshold"))


QUERIES["saved_models"] = q_saved_models


def q_training_vectors(spark, sf_dir):
    """What the fits of three folds read: weights, and vectors
    imputed, ranged and standardised by their own training rows. Features:
    coordinates, and a balance with gaps."""
    feats = ["Latitude", "Longitude", "balance"]
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("row_id"), F.pmod("c_custkey", F.lit(3)).cast("int").alias("fold"),
        F.when(F.pmod("c_custkey", F.lit(7)) > 0, F.col("c_acctbal")).alias("balance"))
    pts = td.customer_points(spark, sf_dir).select(F.substring("ID", 2, 20).cast("long").alias("row_id"), "Latitude", "Longitude",
                                                   F.col("Occurrence Status").alias("y"))
    train = pts.join(c, "row_id")
    sets = models.fold_sets(train, train.limit(0).select("row_id", *feats), feats, 3)
    parts = [F.get(vector_to_array(F.col(kind)), F.lit(i)).alias(f"{kind}_{i}") for kind in ("raw", "ranged", "standard") for i in range(3)]
    return finish(sets.table.select("set", "role", "row_id", "y", "weight", *parts))


QUERIES["training_vectors"] = q_training_vectors


def q_model_suite(spark, sf_dir):
    """The whole registry in its full sizes, seed variants, bags,
    pseudo-absences, blends, stacks and calibrated copies, with artifacts."""
    tr, ts, feats, cells = _model_tables(spark, sf_dir)
    out = scratch_path(spark, f"suite-{uuid.uuid4().hex[:12]}")
    table, _ = suite.run_suite(tr, ts, feats, FULL, absences=_absences(tr, cells, feats), output_dir=out)
    return finish(table)


QUERIES["model_suite"] = q_model_suite
