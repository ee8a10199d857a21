"""The candidate suite (lifecycle 3.2) over long prediction tables.

Base models (registry, seed variants, negative bags, pseudo-absences) form one
pool. Ensembles, blends and stacks draw their members from that pool only; the
calibrated copies are made of the best of all candidates. Every step writes
its predictions once and scores all of its candidates with one sweep; only
records of candidates (typed, bounded by their number) reach the driver.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ModelParams, local_grid, optimize_grid, public_grid
from ..operators import blend, calibrate, metrics, models, select, split
from ..operators.sampling import negative_bags
from ..session import materialised
from ..sources import store

COLS = ["candidate", "split", "row_id", "y", "fold", "p"]
STACKERS = ("logistic_regression", "boosted_trees")
BENCHMARK_COLUMNS = ("srad_median", "vap_median")


@dataclass
class Record:
    """What is known of a candidate: how it was made, and its best threshold."""
    name: str
    method: str
    members: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    order: int = -1
    threshold: float = 0.0
    oof_f1: float = 0.0


class Candidates:
    """Records in building order, and the written predictions they are in."""

    def __init__(self, params: ModelParams):
        self.params = params
        self.records: dict[str, Record] = {}
        self.tables: dict[str, DataFrame] = {}

    def scores(self, long: DataFrame) -> dict[str, tuple[float, float]]:
        sweep = metrics.threshold_sweep(long.where("split = 'oof'"), optimize_grid(self.params))
        return {r["candidate"]: (r["threshold"], r["oof_f1"]) for r in metrics.best_threshold(sweep).collect()}

    def add(self, long: DataFrame, records: Sequence[Record], keep=None) -> None:
        """Writes and scores the predictions of ``records``; a later record
        of a name replaces the earlier one. ``keep`` picks the records to keep
        from those with scores."""
        table = materialised(long.select(*COLS), "candidates")
        scores = self.scores(table)
        for i, r in enumerate(records):
            r.order, (r.threshold, r.oof_f1) = i, scores[r.name]
        for r in keep(records) if keep else records:
            old = self.records.get(r.name)
            r.order = old.order if old else len(self.records)
            self.records[r.name], self.tables[r.name] = r, table

    def ranked(self, names=None) -> list[str]:
        return sorted(self.records if names is None else names, key=lambda n: (-self.records[n].oof_f1, self.records[n].order))

    def long(self, names: Sequence[str]) -> DataFrame:
        """The predictions of ``names``: one filter for each table that has any."""
        out = None
        for table in {id(self.tables[n]): self.tables[n] for n in names}.values():
            own = table.where(F.col("candidate").isin([n for n in names if self.tables[n] is table]))
            out = own if out is None else out.unionByName(own)
        return out

    def diverse(self, names: Sequence[str], top_k: int) -> list[str]:
        ranked = self.ranked(names)
        corr = metrics.correlations(metrics.wide_predictions(self.long(ranked).where("split = 'oof'"), ranked), ranked)
        return metrics.select_diverse(ranked, corr, top_k, self.params.ensembles.max_correlation)

    def table(self, spark) -> DataFrame:
        rows = [(r.name, r.method, r.members, r.order, float(r.threshold), float(r.oof_f1)) for r in self.records.values()]
        return spark.createDataFrame(rows, "candidate string, method string, members array<string>, build_order int, threshold double, oof_f1 double")


def _best_by_size(records: Sequence[Record]) -> list[Record]:
    """The best pair and the best triple; the first on ties."""
    out = []
    for size in (2, 3):
        own = [r for r in records if len(r.members) == size]
        out += [min(own, key=lambda r: (-r.oof_f1, r.order))] if own else []
    return out


def _blended(c: Candidates, members: list[str], specs, method: str, ranked: bool = False) -> None:
    if len(members) < 2:
        return
    source = c.long(members).select("candidate", "split", "row_id", "y", "p")
    if ranked:
        source = blend.rank_normalize(source, ("candidate", "split"))
    wide = metrics.wide_predictions(source, members, ("split", "row_id", "y"))
    long = blend.blend_predictions(wide, specs, mean=ranked).withColumn("fold", F.lit(None).cast("int"))
    c.add(long, [Record(name, method, list(own), list(w)) for name, own, w in specs], _best_by_size)


def _stacked(c: Candidates, members: list[str], train: DataFrame, reg: dict, k: int) -> None:
    """members' held-out predictions are the features of the meta-models."""
    wide = metrics.wide_predictions(c.long(members), members, ("split", "row_id"))
    meta = [f"meta_{i}" for i in range(len(members))]  # J6 columns; names may contain dots
    wide = wide.select("split", "row_id", *[F.col(f"`{m}`").alias(x) for m, x in zip(members, meta)])
    folds = train.select(F.col("row_id").cast("string").alias("row_id"), "y", "fold")
    sets = models.fold_sets(wide.where("split = 'oof'").join(folds, "row_id").select("row_id", "y", "fold", *meta),
                            wide.where("split = 'test'").select("row_id", *meta), meta, k)
    c.add(models.all_predictions({f"stacking_{n}": reg[n] for n in STACKERS if n in reg}, sets), [Record(f"stacking_{n}", "stack", members) for n in STACKERS if n in reg])


def _calibrated(c: Candidates, names: list[str], groups: DataFrame, params: ModelParams) -> None:
    """Cross-fitted copies; the folds have a seed of their own."""
    folds = split.group_folds(groups, "grp", "y", params.folds, params.seed + 17)
    own = materialised(groups.join(folds.select("grp", F.col("fold").alias("__fold")), "grp")
                       .select(F.col("row_id").cast("string").alias("row_id"), "__fold"), "calibration-folds")
    methods = params.ensembles.calibrations
    if names and methods:
        rows = c.long(names).join(own, "row_id", "left").select("candidate", "split", "row_id", "y", F.col("__fold").alias("fold"), "p")
        copies = calibrate.cross_fit(materialised(rows, "calibration-scores"), methods, params.folds, "mean")
        c.add(copies, [Record(f"{n}_cal_{m}", f"calibrated_{m}", [n]) for n in names for m in methods])


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0].select(*COLS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*COLS))
    return out


def random_split_benchmark(train: DataFrame, features: Sequence[str], params: ModelParams, fraction: float = 0.3) -> dict:
    """Logistic model on one stratified split; F1 at 0.5 of the validation rows."""
    rows = split.stratified_split(train.select("row_id", "y", *features), "row_id", "y", fraction, params.seed)
    sets = models.split_set(rows, features)
    preds = models.set_predictions("benchmark", models.logistic(params.sizes), sets)
    r = metrics.threshold_sweep(preds, [0.5]).first()
    return {"threshold": 0.5, "tp": r["tp"], "fp": r["fp"], "fn": r["fn"], "f1_at_0_50": r["f1"]}


def run_suite(train: DataFrame, test: DataFrame, features: Sequence[str], params: ModelParams = ModelParams(),
              absences: DataFrame | None = None, variants=("extra_trees", "boosted_slow"), base_models: Sequence[str] | None = None,
              output_dir: str | None = None) -> tuple[DataFrame, dict]:
    """``train``: row_id, y, fold, grp, features; ``test``: row_id, features;
    ``absences``: fold, bag, ID, y, features (select_pseudo_absences joined
    with their cells' features). ``variants``: models that are also fitted on
    negative bags and with pseudo-absences. ``base_models``: of the registry
    (default: all). Returns (candidates table, best record)."""
    features, k, e = list(features), params.folds, params.ensembles
    reg = models.registry(params)
    reg = {n: reg[n] for n in base_models} if base_models else reg
    c = Candidates(params)
    sets = models.fold_sets(train, test, features, k)
    c.add(models.all_predictions(reg, sets), [Record(n, "base") for n in reg])
    fold_rows = {}
    for r in models.fold_f1(c.long(list(reg))).orderBy("candidate", "fold").collect():
        fold_rows.setdefault(r["candidate"], []).append({"fold": r["fold"], "f1_at_0_50": r["f1_at_0_50"]})
    own = [n for n in variants if n in reg]
    draws = negative_bags(train.select("row_id", "y", "fold"), k, params.bagging.bags, params.bagging.fraction, params.seed)
    schemes = {"negative_bagged": models.bag_sets(train, test, draws, features, k, params.bagging.bags)}
    if absences is not None:
        schemes["pseudo_absence"] = models.background_sets(train, test, absences, features, k, params.background.bags)
    for scheme, own_sets in schemes.items():
        c.add(models.all_predictions({f"{n}_{scheme}": reg[n] for n in own}, own_sets), [Record(f"{n}_{scheme}", scheme) for n in own])

    base = list(c.records)
    top = c.diverse(base, max(3, e.diverse, e.stacked))
    means = [Record(f"ensemble_mean_top{n}", "mean", top[:n]) for n in (2, 3) if len(top) >= n]
    if means:
        c.add(_union([blend.mean_ensemble(c.long(r.members), r.members, r.name).withColumn("fold", F.lit(None).cast("int")) for r in means]), means)
    _blended(c, top[:min(4, e.diverse)], blend.weighted_specs(top[:min(4, e.diverse)]), "weighted")
    _blended(c, top[:min(5, e.diverse)], blend.rank_specs(top[:min(5, e.diverse)]), "rank", ranked=True)
    if len(top) >= 2:
        _stacked(c, top[:e.stacked], train, reg, k)
    _calibrated(c, c.diverse(list(c.records), e.calibrated), train.select("row_id", "y", "grp"), params)

    best = c.records[c.ranked()[0]]  # T2: the first maximum wins
    record = {"best_model_name": best.name, "threshold": best.threshold, "oof_f1": best.oof_f1, "members": best.members}
    if output_dir:
        benchmark = random_split_benchmark(train, [f for f in BENCHMARK_COLUMNS if f in features] or features, params)
        write_artifacts(c, record, test, output_dir, params, features, benchmark, fold_rows)
    return c.table(train.sparkSession), record


def write_artifacts(c: Candidates, record: dict, test: DataFrame, out: str, params: ModelParams, features: Sequence[str],
                    benchmark: dict, fold_rows: dict) -> None:
    """S9 predictions and metrics, S15 summary, S7 submission, S10 sweeps."""
    spark = test.sparkSession
    store.write_predictions(c.long(list(c.records)), f"{out}/models")
    found = {n: {"method": r.method, "members": r.members, "weights": r.weights, "threshold": r.threshold, "oof_f1": r.oof_f1,
                 "fold_rows": fold_rows.get(n, [])} for n, r in c.records.items()}
    for n, m in found.items():
        store.write_json(spark, f"{out}/metrics/{n}_metrics.json", {k: m[k] for k in ("threshold", "oof_f1", "fold_rows")})
    store.write_json(spark, f"{out}/baseline_summary.json",
                     {"benchmark": benchmark, "feature_columns": list(features), "models": found, "best_model_name": record["best_model_name"],
                      "best_threshold": record["threshold"], "best_oof_f1": record["oof_f1"]})
    rows = c.long([record["best_model_name"]]).where("split = 'test'").withColumn("ID", F.col("row_id").cast("string"))
    select.submission(rows, record["threshold"]).write.mode("overwrite").option("header", True).csv(f"{out}/final_submission")
    select.write_fanout(select.threshold_fanout(rows, {"local": local_grid(record["threshold"], params),
                                                       "public": public_grid(params)}), f"{out}/submission_sweeps")


def load_summary(spark, out: str) -> dict | None:
    """Resume from a saved run - the best-candidate record of the
    summary JSON, or None when there is no readable summary."""
    path = f"{out}/baseline_summary.json"
    try:
        summary = store.read_json(spark, path)
    except Exception:  # noqa: BLE001 - missing or unreadable summary
        return None
    return {"best_model_name": str(summary["best_model_name"]), "threshold": float(summary["best_threshold"]),
            "oof_f1": float(summary["best_oof_f1"])}


def resume_or_run(spark, out: str, run):
    """Finalize's rule: reuse a saved summary, else run the suite."""
    rec = load_summary(spark, out)
    return rec if rec is not None else run()
