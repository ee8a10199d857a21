"""Registered scoring / selection queries over the score binding
(labels x documents, deterministic candidate probabilities)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ModelParams, focus_grid, local_grid, optimize_grid, public_grid
from ..functions.scalar import beta_basis, logit, sigmoid, spatial_block
from ..operators import blend, calibrate, metrics, select, split
from ..session import materialised
from ..sources import testdata as td
from .queries_features import finish

MC = ModelParams()
NAMES = td.candidate_names()


def _preds(spark, sf_dir):
    return td.score_predictions(spark, sf_dir)


def _oof(spark, sf_dir):
    return _preds(spark, sf_dir).where(F.col("split") == "oof")


def written_scores(spark, sf_dir) -> DataFrame:
    """split, row_id, y, grp and one column for each candidate, written once
    for all the jobs of a query."""
    return materialised(metrics.wide_predictions(_preds(spark, sf_dir), NAMES, ("split", "row_id", "y", "grp")), "scores")


def long_scores(wide: DataFrame, names=NAMES) -> DataFrame:
    items = F.array(*[F.struct(F.lit(n).alias("candidate"), F.col(f"`{n}`").alias("p")) for n in names])
    return wide.select("split", "row_id", "y", F.explode(items).alias("c")).select("c.candidate", "split", "row_id", "y", "c.p")


def q_threshold_sweep(spark, sf_dir):
    return finish(metrics.threshold_sweep(_oof(spark, sf_dir), optimize_grid(MC)))


def _best(spark, sf_dir):
    sw = metrics.threshold_sweep(_oof(spark, sf_dir), optimize_grid(MC))
    return metrics.best_threshold(sw)


def q_best_threshold(spark, sf_dir):
    return finish(_best(spark, sf_dir))


def _eval(spark, sf_dir):
    g = public_grid(MC)
    ev = metrics.candidate_eval(_oof(spark, sf_dir), g, focus_grid(g, MC))
    orders = spark.createDataFrame([(n, i) for i, n in enumerate(NAMES)], "candidate string, build_order int")
    return metrics.rank_candidates(ev.join(F.broadcast(orders), "candidate"))


def q_candidate_eval(spark, sf_dir):
    return finish(_eval(spark, sf_dir))


def q_recommendations(spark, sf_dir):
    return finish(metrics.recommendations(_eval(spark, sf_dir), public_grid(MC)))


def q_confusion(spark, sf_dir):
    return metrics.confusion(_oof(spark, sf_dir), F.lit(0.5))


def q_class_report(spark, sf_dir):
    return finish(metrics.class_report(_oof(spark, sf_dir), F.lit(0.5)))


def q_candidate_corr(spark, sf_dir):
    return finish(metrics.candidate_corr(_oof(spark, sf_dir), NAMES))


def ranked_names(wide: DataFrame) -> list[str]:
    """Candidates by OOF F1 desc, build order on ties (small collect)."""
    sweep = metrics.threshold_sweep(long_scores(wide.where("split = 'oof'")), optimize_grid(MC))
    order = {n: i for i, n in enumerate(NAMES)}
    return [r.candidate for r in sorted(metrics.best_threshold(sweep).collect(), key=lambda r: (-r.oof_f1, order[r.candidate]))]


def diverse(spark, sf_dir, k: int, wide: DataFrame | None = None) -> list[str]:
    wide = written_scores(spark, sf_dir) if wide is None else wide
    corr = metrics.correlations(wide.where("split = 'oof'"), NAMES)
    return metrics.select_diverse(ranked_names(wide), corr, k, MC.ensembles.max_correlation)


def q_diverse_topk(spark, sf_dir):
    sel = diverse(spark, sf_dir, MC.ensembles.diverse)
    best = _best(spark, sf_dir)
    picks = spark.createDataFrame([(n, i + 1) for i, n in enumerate(sel)], "candidate string, pick int")
    return finish(picks.join(best, "candidate"))


def q_rank_normalize(spark, sf_dir):
    return finish(blend.rank_normalize(_preds(spark, sf_dir)).select("candidate", "split", "row_id", "p"))


def _scored_blends(wide, specs, mean=False):
    """The best threshold of every blend; the first best pair and triple."""
    long = blend.blend_predictions(wide.where("split = 'oof'"), specs, mean=mean)
    sw = metrics.threshold_sweep(long, optimize_grid(MC), ("candidate", "build_order"))
    best = metrics.best_threshold(sw, ("candidate", "build_order"))
    pairs = sum(len(members) == 2 for _, members, _ in specs)  # pairs are built first
    w = Window.partitionBy("kind").orderBy(F.col("oof_f1").desc(), F.col("build_order"))
    return (best.withColumn("kind", F.when(F.col("build_order") < pairs, "pair").otherwise("triplet"))
            .withColumn("is_best", F.row_number().over(w) == 1))


def q_weighted_blends(spark, sf_dir):
    wide = written_scores(spark, sf_dir)
    members = diverse(spark, sf_dir, min(4, MC.ensembles.diverse), wide)
    return finish(_scored_blends(wide, blend.weighted_specs(members)))


def q_rank_blends(spark, sf_dir):
    wide = written_scores(spark, sf_dir)
    members = diverse(spark, sf_dir, min(5, MC.ensembles.diverse), wide)
    ranked = blend.rank_normalize(long_scores(wide.where("split = 'oof'"), members))
    return finish(_scored_blends(metrics.wide_predictions(ranked, members, ("split", "row_id", "y")), blend.rank_specs(members), mean=True))


def q_fold_average(spark, sf_dir):
    fp = td.fold_test_predictions(spark, sf_dir)
    return finish(blend.fold_average(fp, ("candidate", "row_id"), ("bag", "fold")))


def q_meta_features(spark, sf_dir):
    oof = _oof(spark, sf_dir)
    return finish(metrics.wide_predictions(oof, NAMES, ("row_id", "y", "grp")))


def q_mean_ensembles(spark, sf_dir):
    sel = diverse(spark, sf_dir, 3)
    p = _preds(spark, sf_dir)
    two = blend.mean_ensemble(p, sel[:2], "mean_top2")
    three = blend.mean_ensemble(p, sel[:3], "mean_top3")
    return finish(two.unionByName(three))


def source_prevalence(spark, sf_dir) -> float:
    return float(td.score_rows(spark, sf_dir).where("split = 'oof'").agg(F.avg("y")).first()[0])


def q_prior_shift(spark, sf_dir):
    test = _preds(spark, sf_dir).where(F.col("split") == "test").select("candidate", "row_id", "p")
    adj, _ = calibrate.prior_shift(test, source_prevalence(spark, sf_dir))
    return finish(adj)


def _family_best(best, names):
    w = Window.orderBy(F.col("oof_f1").desc(), F.col("build_order"))
    orders = F.element_at(F.create_map(*[x for i, n in enumerate(NAMES) for x in (F.lit(n), F.lit(i))]),
                          F.col("candidate"))
    return (best.where(F.col("candidate").isin(names)).withColumn("build_order", orders)
            .withColumn("__r", F.row_number().over(w)).where("__r = 1")
            .select("candidate", "threshold", "oof_f1"))


def _selection(spark, sf_dir):
    """Baseline family m0-m3, neural family m4-m7, and in the place of the
    combined stack (``finalise_run`` fits a real one) the mean of the top two
    diverse candidates, scored like every candidate."""
    best = _best(spark, sf_dir)
    sel = diverse(spark, sf_dir, 2)
    comb = blend.mean_ensemble(_preds(spark, sf_dir), sel, "mean_top2")
    csw = metrics.threshold_sweep(comb.where("split = 'oof'"), optimize_grid(MC))
    cbest = metrics.best_threshold(csw)
    return select.final_selection(_family_best(best, NAMES[:4]), _family_best(best, NAMES[4:]), cbest)


def q_final_selection(spark, sf_dir):
    return finish(_selection(spark, sf_dir))


def _chosen_test(spark, sf_dir):
    ch = _selection(spark, sf_dir).first()
    p = _preds(spark, sf_dir)
    if ch.source == "combined_stack":
        sel = diverse(spark, sf_dir, 2)
        t = blend.mean_ensemble(p, sel, "mean_top2")
    else:
        t = p.where(F.col("candidate") == ch.best_model_name)
    t = t.where("split = 'test'").withColumn("ID", F.col("row_id").cast("string"))
    return t, ch


def q_submission(spark, sf_dir):
    t, ch = _chosen_test(spark, sf_dir)
    return select.submission(t, ch.best_threshold)


def q_threshold_fanout(spark, sf_dir):
    t, ch = _chosen_test(spark, sf_dir)
    grids = {"local": local_grid(ch.best_threshold, MC), "public": public_grid(MC)}
    return finish(select.threshold_fanout(t, grids))


def q_spatial_blocks(spark, sf_dir):
    pts = td.customer_points(spark, sf_dir)
    return pts.select("ID", spatial_block("Latitude", "Longitude", 0.5).alias("spatial_group"))


def _rows(spark, sf_dir):
    return td.score_rows(spark, sf_dir).where(F.col("split") == "oof")


def q_group_folds(spark, sf_dir):
    return split.group_folds(_rows(spark, sf_dir), "grp", "y", MC.folds, MC.seed)


def q_stratified_split(spark, sf_dir):
    return split.stratified_split(_rows(spark, sf_dir).select("row_id", "y"), "row_id", "y", 0.3,
                                  MC.seed)


def q_class_weights(spark, sf_dir):
    return finish(split.class_weights(_rows(spark, sf_dir).select("row_id", "y"), "y"))


def q_score_transforms(spark, sf_dir):
    """Log odds, their inverse and the beta basis of every score."""
    low, high = beta_basis("p")
    return finish(_preds(spark, sf_dir).select("candidate", "row_id", logit("p").alias("log_odds"), sigmoid(logit("p")).alias("back"),
                                               low.alias("log_p"), high.alias("neg_log_q")))


QUERIES = {
    "score_transforms": q_score_transforms,
    "threshold_sweep": q_threshold_sweep,
    "best_threshold": q_best_threshold,
    "candidate_eval": q_candidate_eval,
    "recommendations": q_recommendations,
    "confusion": q_confusion,
    "class_report": q_class_report,
    "candidate_corr": q_candidate_corr,
    "diverse_topk": q_diverse_topk,
    "rank_normalize": q_rank_normalize,
    "weighted_blends": q_weighted_blends,
    "rank_blends": q_rank_blends,
    "fold_average": q_fold_average,
    "meta_features": q_meta_features,
    "mean_ensembles": q_mean_ensembles,
    "prior_shift": q_prior_shift,
    "final_selection": q_final_selection,
    "submission": q_submission,
    "threshold_fanout": q_threshold_fanout,
    "spatial_blocks": q_spatial_blocks,
    "group_folds": q_group_folds,
    "stratified_split": q_stratified_split,
    "class_weights": q_class_weights,
}
