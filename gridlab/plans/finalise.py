"""Finalising two saved runs.

A run is a folder with a summary (its models' held-out F1 and thresholds) and
the predictions of its models. The combined stack is fitted on the saved
held-out columns of both runs' best models; the better of its meta-models, the
first run's best and the second run's best model compete by held-out F1. All
decisions are taken from the summaries and one sweep; predictions stay tables.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ModelParams, local_grid, optimize_grid, public_grid
from ..operators import metrics, models, select
from ..session import materialised
from ..sources import store
from .suite import STACKERS

BASELINE_TOP, NEURAL_TOP = 4, 3


class Stack(NamedTuple):
    """The better meta-model, its members, and its predictions."""
    name: str
    threshold: float
    oof_f1: float
    members: list[str]
    predictions: DataFrame


def save_run(spark: SparkSession, out: str, summary: str, preds: DataFrame, params: ModelParams = ModelParams()) -> dict:
    """Writes a run's artifacts: predictions (candidate, split, row_id, y, p)
    partitioned by split and candidate, and the summary of their thresholds.
    Ties of the best model go to the first name."""
    store.write_predictions(preds.select("candidate", "split", "row_id", "y", "p"), f"{out}/models")
    found = {r["candidate"]: {"threshold": r["threshold"], "oof_f1": r["oof_f1"]} for r in metrics.best_threshold(
        metrics.threshold_sweep(preds.where("split = 'oof'"), optimize_grid(params))).collect()}
    best = min(found, key=lambda n: (-found[n]["oof_f1"], n))
    record = {"models": found, "best_model_name": best, "best_threshold": found[best]["threshold"], "best_oof_f1": found[best]["oof_f1"]}
    store.write_json(spark, f"{out}/{summary}", record)
    return record


def _ranked(summary: dict) -> list[str]:
    return sorted(summary["models"], key=lambda n: (-float(summary["models"][n]["oof_f1"]), n))


def stack_members(baseline: dict, neural: dict, have_baseline: set[str], have_neural: set[str]) -> list[tuple[str, str]]:
    """(run, model) of the best four of the first run that have held-out
    and test rows, and the best three of the second that have them and are no
    ensembles. The first run is cut before, the second after that test."""
    first = [n for n in _ranked(baseline)[:BASELINE_TOP] if n in have_baseline]
    second = [n for n in _ranked(neural) if not n.startswith("ensemble_") and n in have_neural][:NEURAL_TOP]
    return [("baseline", n) for n in first] + [("neural", n) for n in second]


def _complete(preds: DataFrame) -> set[str]:
    """Candidates with rows of both splits (bounded by the models of a run)."""
    rows = preds.groupBy("candidate").agg(F.countDistinct("split").alias("n")).where("n = 2").collect()
    return {str(r["candidate"]) for r in rows}


def combined_stack(train: DataFrame, baseline: tuple[dict, DataFrame], neural: tuple[dict, DataFrame],
                   params: ModelParams = ModelParams()) -> Stack | None:
    """Meta-models over two runs' (summary, predictions); the later one
    must be strictly better. None with fewer than two members. train: row_id,
    y, fold."""
    members = stack_members(baseline[0], neural[0], _complete(baseline[1]), _complete(neural[1]))
    if len(members) < 2:
        return None
    named = [f"meta_{i}" for i in range(len(members))]  # a model name may stand in both runs
    parts = []
    for run, (_, preds) in (("baseline", baseline), ("neural", neural)):
        own = {n: x for (r, n), x in zip(members, named) if r == run}
        if own:
            table = train.sparkSession.createDataFrame(list(own.items()), "candidate string, meta string")
            parts.append(preds.join(F.broadcast(table), "candidate").select("split", F.col("row_id").cast("string").alias("row_id"),
                                                                           F.col("meta").alias("candidate"), "p"))
    long = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    wide = materialised(metrics.wide_predictions(long, named, ("split", "row_id")), "meta-features")
    folds = train.select(F.col("row_id").cast("string").alias("row_id"), "y", "fold")
    sets = models.fold_sets(wide.where("split = 'oof'").join(folds, "row_id").select("row_id", "y", "fold", *named),
                            wide.where("split = 'test'").select("row_id", *named), named, params.folds)
    reg = models.registry(params)
    preds = materialised(models.all_predictions({f"combined_{n}": reg[n] for n in STACKERS}, sets), "combined-stacks")
    scores = {r["candidate"]: r for r in metrics.best_threshold(metrics.threshold_sweep(preds.where("split = 'oof'"), optimize_grid(params))).collect()}
    best = max((f"combined_{n}" for n in STACKERS), key=lambda n: scores[n]["oof_f1"])  # the first of equals
    return Stack(best, scores[best]["threshold"], scores[best]["oof_f1"], [n for _, n in members], preds.where(F.col("candidate") == best))


def choose(baseline_f1: float, neural_f1: float | None, stack_f1: float | None) -> str:
    """The combined stack if it beats both runs, else the second run if it
    beats the first; ties stay with the first."""
    if neural_f1 is None:
        return "baseline"
    if stack_f1 is not None and stack_f1 > max(baseline_f1, neural_f1):
        return "combined_stack"
    return "neural" if neural_f1 > baseline_f1 else "baseline"


def finalise(spark: SparkSession, out: str, baseline_dir: str, neural_dir: str | None, train: DataFrame, test: DataFrame,
             params: ModelParams = ModelParams(), run=None) -> dict:
    """Resumes the first run from its summary (``run()`` makes it where there is
    none), decides, and writes the submission, its sweeps and the report
    ``final_selection.json``, which is returned. test: row_id and, if the second
    run saved an ensemble, its features."""
    if not store._exists(spark, f"{baseline_dir}/baseline_summary.json"):
        if run is None:
            raise FileNotFoundError(f"no summary in {baseline_dir}")
        run()
    base = store.read_json(spark, f"{baseline_dir}/baseline_summary.json")
    base_preds = store.read_probability_artifacts(spark, f"{baseline_dir}/models")
    neural = stack = None
    if neural_dir and store._exists(spark, f"{neural_dir}/neural_summary.json"):
        neural = store.read_json(spark, f"{neural_dir}/neural_summary.json")
        neural_preds = store.read_probability_artifacts(spark, f"{neural_dir}/models")
        stack = combined_stack(train, (base, base_preds), (neural, neural_preds), params)
    source = choose(float(base["best_oof_f1"]), float(neural["best_oof_f1"]) if neural else None, stack.oof_f1 if stack else None)
    report: dict = {"source": source, "submission_path": f"{out}/final_submission"}
    if source == "combined_stack":
        scores, threshold, name, f1 = stack.predictions.where("split = 'test'"), stack.threshold, stack.name, stack.oof_f1
        report |= {"summary_path": f"{neural_dir}/neural_summary.json", "meta_feature_names": stack.members}
    else:
        where, own, preds = (neural_dir, neural, neural_preds) if source == "neural" else (baseline_dir, base, base_preds)
        name, threshold, f1 = own["best_model_name"], float(own["best_threshold"]), float(own["best_oof_f1"])
        report["summary_path"] = f"{where}/{'neural' if source == 'neural' else 'baseline'}_summary.json"
        if source == "neural" and store._exists(spark, f"{neural_dir}/ensemble/ensemble_summary.json"):
            scores, _ = models.score_ensemble(f"{neural_dir}/ensemble", test)  # M15: the saved models score the test rows
        else:
            scores = preds.where((F.col("split") == "test") & (F.col("candidate") == name))
    rows = materialised(scores.select(F.col("row_id").cast("string").alias("ID"), "p"), "final-scores")
    grids = {"local": local_grid(threshold, params), "public": public_grid(params)}
    select.submission(rows, threshold).write.mode("overwrite").option("header", True).csv(f"{out}/final_submission")
    select.write_fanout(select.threshold_fanout(rows, grids), f"{out}/submission_sweeps")
    report |= {"best_model_name": name, "best_oof_f1": float(f1), "best_threshold": float(threshold),
               "threshold_sweep_paths": [f"{out}/submission_sweeps/grid={g}/label={t:.2f}" for g, ts in grids.items() for t in ts]}
    store.write_json(spark, f"{out}/final_selection.json", report)
    return report
