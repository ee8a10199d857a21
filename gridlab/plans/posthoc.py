"""Post-hoc candidate generation (lifecycle 3.3; E3, E7, E8, E12-E14, E16, E17, T4).

Candidates live in one long predictions table (candidate, split, row_id,
y, p). Every candidate set is scored by one E3 evaluation job; only the
per-candidate metric rows (bounded by the candidate count) are ranked on
the driver to decide the next step, exactly like the reference's flow.
"""
from __future__ import annotations

from itertools import combinations

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ModelParams, focus_grid, public_grid
from ..operators import blend, calibrate, metrics
from ..session import materialised
from ..sources import store

KEY = ("focus_best_oof_f1", "focus_mean_oof_f1", "best_oof_f1")
EVAL_COLS = ["best_threshold", "best_oof_f1", "focus_best_threshold", "focus_best_oof_f1",
             "focus_mean_oof_f1", "focus_min_oof_f1"]


class Pool:
    """Name-keyed candidate store (U3: later wins) with insertion order."""

    def __init__(self, grid, focus):
        self.grid, self.focus = grid, focus
        self.preds: dict[str, DataFrame] = {}
        self.metrics: dict[str, dict] = {}
        self.order: dict[str, int] = {}

    def evaluate(self, preds: DataFrame) -> dict[str, dict]:
        ev = metrics.candidate_eval(preds.where("split = 'oof'"), self.grid, self.focus).collect()
        return {r.candidate: r.asDict() for r in ev}

    def add(self, name: str, preds: DataFrame, m: dict):
        self.order.setdefault(name, len(self.order))
        self.preds[name] = preds.select(F.lit(name).alias("candidate"), "split", "row_id", "y", "p")
        self.metrics[name] = {**m, "candidate": name}

    def ranked(self) -> list[str]:
        return sorted(self.metrics, key=lambda n: (tuple(-self.metrics[n][k] for k in KEY), self.order[n]))

    def long(self, names) -> DataFrame:
        out = None
        for n in names:
            out = self.preds[n] if out is None else out.unionByName(self.preds[n])
        return out


def posthoc(preds: DataFrame, baseline_ranked: list[str], neural_ranked: list[str], folds: DataFrame | None,
            source_prevalence: float, cfg: ModelParams = ModelParams(), top_k: int = 6,
            calibration_methods=("beta", "sigmoid", "isotonic"), max_candidates: int = 10):
    """Returns (ranked candidate metrics DataFrame, long predictions of the
    selected candidates)."""
    spark = preds.sparkSession
    grid = public_grid(cfg)
    pool = Pool(grid, focus_grid(grid, cfg))
    names = baseline_ranked[:top_k]
    base = preds.where(F.col("candidate").isin(names))
    ev = pool.evaluate(base)
    for n in names:
        pool.add(n, base.where(F.col("candidate") == n), ev[n])
    # E12/E13 (post-hoc mode): cross-fitted OOF, one full-data calibrator for test
    if folds is not None:
        plain = [n for n in names[:4] if "_cal_" not in n]
        one = base.where(F.col("candidate").isin(plain)).join(folds, "row_id", "left")
        allcal = calibrate.cross_fit(one.select("candidate", "split", "row_id", "y", "fold", "p"), calibration_methods,
                                     cfg.folds, test_mode="full")
        allcal = allcal.withColumn("candidate", F.regexp_replace("candidate", "_cal_(?=[a-z]+$)", "_post_"))
        allcal = materialised(allcal.select("candidate", "split", "row_id", "y", "p"), "calibrated", ("candidate",))
        cev = pool.evaluate(allcal)
        for n in plain:
            for m in calibration_methods:
                pool.add(f"{n}_post_{m}", allcal.where(F.col("candidate") == f"{n}_post_{m}"), cev[f"{n}_post_{m}"])
    seeds = pool.ranked()[:6]
    # Per pair of the first four seeds, the best of 9 weights by the
    # lexicographic key (first wins ties), plus one rank blend
    wide = metrics.wide_predictions(pool.long(seeds[:4]), seeds[:4], ("split", "row_id", "y"))
    pairs = list(combinations(seeds[:4], 2))
    specs = []
    for a, b in pairs:
        specs += [(f"blend_{a}_{w:.1f}__{b}_{1.0 - w:.1f}", [a, b], [w, 1.0 - w]) for w in blend.pair_weights()]
    if specs:
        bl = blend.blend_predictions(wide, specs).drop("build_order")
        bev = pool.evaluate(bl)
        ranked_seed = blend.rank_normalize(pool.long(seeds[:4]))
        rwide = metrics.wide_predictions(ranked_seed, seeds[:4], ("split", "row_id", "y"))
        rspecs = [(f"rank_{a}__{b}", [a, b], [0.5, 0.5]) for a, b in pairs]
        rb = blend.blend_predictions(rwide, rspecs, mean=True).drop("build_order")
        rev = pool.evaluate(rb)
        nw = len(blend.pair_weights())
        for i, (a, b) in enumerate(pairs):
            cand = [s[0] for s in specs[i * nw:(i + 1) * nw]]
            best = min(cand, key=lambda n: (tuple(-bev[n][k] for k in KEY), cand.index(n)))
            pool.add(best, blend.blend_predictions(wide, [specs[i * nw + cand.index(best)]]), bev[best])
            rn = f"rank_{a}__{b}"
            pool.add(rn, blend.blend_predictions(rwide, [rspecs[i]], mean=True), rev[rn])
    # Prior-shift copies of the first three seeds (test side only)
    test3 = pool.long(seeds[:3]).where("split = 'test'").select("candidate", "row_id", "p")
    adj, prev = calibrate.prior_shift(test3, source_prevalence)
    for n in seeds[:3]:
        an = f"prior_shift_{n}_p_{prev[n]:.3f}"
        p = pool.preds[n].where("split = 'oof'").unionByName(
            adj.where(F.col("candidate") == n).select(F.lit(n).alias("candidate"), F.lit("test").alias("split"),
                                                      "row_id", F.lit(None).cast("int").alias("y"), "p"))
        pool.add(an, p, pool.metrics[n])
    # Cross blends 0.8 baseline + 0.2 neural, top 2 x top 2
    top2 = pool.ranked()[:2]
    neural = neural_ranked[:2]
    if neural:
        npreds = preds.where(F.col("candidate").isin(neural)).select("candidate", "split", "row_id", "y", "p")
        cwide = metrics.wide_predictions(pool.long(top2).unionByName(npreds), [*top2, *neural],
                                         ("split", "row_id", "y"))
        cspecs = [(f"cross_{b}_0.8__{n}_0.2", [b, n], [0.8, 0.2]) for b in top2 for n in neural]
        cb = blend.blend_predictions(cwide, cspecs).drop("build_order")
        cev = pool.evaluate(cb)
        for spec in cspecs:
            pool.add(spec[0], blend.blend_predictions(cwide, [spec]), cev[spec[0]])
    final = pool.ranked()[:max_candidates]
    rows = [(n, i + 1, pool.order[n], *[float(pool.metrics[n][c]) for c in EVAL_COLS]) for i, n in enumerate(final)]
    schema = "candidate string, rank int, build_order int, " + ", ".join(f"{c} double" for c in EVAL_COLS)
    return spark.createDataFrame(rows, schema), pool.long(final)


NEAR_FOCUS = 0.04


def write_posthoc(ranked: DataFrame, long: DataFrame, out: str, cfg: ModelParams = ModelParams(), sources: dict | None = None) -> dict:
    """The submissions of all selected candidates at all public
    thresholds, written in one job as ``candidate=../label=..`` folders, and a
    manifest of them, which is returned. ranked: one row a candidate with its
    rank and evaluation (bounded by the candidates); long: candidate, split,
    row_id, p. Recommended are the thresholds within ``NEAR_FOCUS`` of a
    candidate's best one in the focus range."""
    spark = long.sparkSession
    grid = public_grid(cfg)
    records = ranked.orderBy("rank").collect()
    items = F.array(*[F.struct(F.lit(f"{t:.2f}").alias("label"), F.lit(float(t)).alias("t")) for t in grid])
    rows = long.where("split = 'test'").join(F.broadcast(ranked.select("candidate")), "candidate", "left_semi") \
        .select("candidate", F.col("row_id").cast("string").alias("ID"), "p", F.explode(items).alias("x")) \
        .select("candidate", "x.label", "ID", (F.col("p") >= F.col("x.t")).cast("int").alias("Target"))
    rows.write.mode("overwrite").partitionBy("candidate", "label").option("header", True).csv(f"{out}/submissions")

    def path(name: str, t: float) -> str:
        return f"{out}/submissions/candidate={quoted(name)}/label={t:.2f}"

    manifest = {
        "thresholds": grid, "focus_thresholds": focus_grid(grid, cfg), "selected_candidate_count": len(records),
        "written_count": len(records) * len(grid), "output_dir": out, **(sources or {}),
        "candidate_rankings": [{"name": r["candidate"], **{c: float(r[c]) for c in EVAL_COLS[:4] + ["focus_mean_oof_f1"]},
                                "recommended_paths": [path(r["candidate"], t) for t in grid if abs(t - r["focus_best_threshold"]) <= NEAR_FOCUS + 1e-9]}
                               for r in records],
        "paths": [path(r["candidate"], t) for r in records for t in grid]}
    store.write_json(spark, f"{out}/posthoc_generation_manifest.json", manifest)
    return manifest


def quoted(name: str) -> str:
    """A candidate's name as Spark writes it in a partition folder."""
    jvm = SparkContext._active_spark_context._jvm
    return jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)


def read_submissions(spark: SparkSession, manifest: dict, recommended: bool = False) -> DataFrame:
    """The written submissions that a manifest names, read back: candidate,
    label, ID, Target."""
    paths = [p for r in manifest["candidate_rankings"] for p in r["recommended_paths"]] if recommended else manifest["paths"]
    return spark.read.schema("ID string, Target int, candidate string, label string").option("header", True) \
        .option("basePath", f"{manifest['output_dir']}/submissions").csv(paths)
