"""Model training as table operators (M1-M15) on ``pyspark.ml``.

A training scheme (plain folds, negative bags, pseudo-absences) is one table
of rows, each written once with the sets that train on it or score it. For
all sets of a scheme together, one pass finds the training side's medians,
ranges, means and deviations. Each fit reads its set's rows and makes the
imputed, range scaled or standardised vectors on the way. Fits are distributed
``pyspark.ml`` jobs, submitted from a bounded thread pool. Nothing of a held-out row reaches a fit:
medians, scales and class weights come from the set's training rows.

Predictions are long tables (candidate, split, row_id, y, fold, p).
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import numpy as np
from pyspark import SparkContext, StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Boosting, ModelParams, ModelSizes
from ..session import materialised, spread
from ..sources import store
from . import columns


# ---- estimators ---------------------------------------------------------------

class Model(NamedTuple):
    """M8: an estimator of (rows, features), the vectors it reads, whether
    classes are balanced by repeating rows (it knows no weights), and for how
    many rounds without a better loss on the held tenth of the training rows
    boosting goes on (0: to its end)."""
    make: Callable
    vectors: str = "raw"
    repeat: bool = False
    patience: int = 0


def logistic(sizes: ModelSizes) -> Model:
    """M4: balanced logistic regression, C = 1 (regParam = 1/n), on ranges."""
    return Model(lambda n, d: LogisticRegression(regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False,
                                                 maxIter=sizes.logistic_iterations, weightCol="weight"), "ranged")


def boosted(preset: Boosting, seed: int) -> Model:
    """M5: boosted trees with early stopping (``staged_boosting``)."""
    return Model(lambda n, d: GBTClassifier(maxIter=preset.rounds, maxDepth=preset.depth, stepSize=preset.rate, subsamplingRate=0.9,
                                            seed=seed, weightCol="weight"), patience=preset.patience)


def forest(trees: int, sizes: ModelSizes, seed: int, features: str, leaf: int) -> Model:
    """M6: randomised trees, balanced weights."""
    return Model(lambda n, d: RandomForestClassifier(numTrees=trees, maxDepth=sizes.tree_depth, featureSubsetStrategy=features,
                                                     minInstancesPerNode=leaf, seed=seed, weightCol="weight"))


def dense_mlp(sizes: ModelSizes, seed: int) -> Model:
    """M7: dense network on standardised vectors, classes balanced by repeating rows."""
    return Model(lambda n, d: MultilayerPerceptronClassifier(layers=[d, *sizes.hidden, 2], maxIter=sizes.network_iterations,
                                                             seed=seed, blockSize=128), "standard", repeat=True)


def registry(params: ModelParams = ModelParams()) -> dict[str, Model]:
    """M8: the base models, and a forest and a boosted variant for each seed."""
    s, seed = params.sizes, params.seed
    out = {"logistic_regression": logistic(s), "boosted_trees": boosted(s.boosted_trees, seed), "boosted_deep": boosted(s.boosted_deep, seed),
           "boosted_slow": boosted(s.boosted_slow, seed), "extra_trees": forest(s.trees, s, seed, "0.6", 1),
           "extra_trees_wide": forest(s.variant_trees, s, seed, "0.5", 2), "dense_mlp": dense_mlp(s, seed)}
    for v in dict.fromkeys(params.seeds):
        out[f"extra_trees_seed_{v}"] = forest(s.variant_trees, s, v, "0.55", 1)
        out[f"boosted_slow_seed_{v}"] = boosted(s.boosted_slow, v)
    return out


FIRST_STAGE = 16


def staged_boosting(est: GBTClassifier, train: DataFrame, held: DataFrame, patience: int, first: int = FIRST_STAGE) -> GBTClassificationModel:
    """Boosted trees up to the round with the smallest loss on ``held``. Rounds
    are fitted in stages, each twice as long as the one before, until the best
    round lies ``patience`` rounds back or all rounds are fitted; with the same
    seed a longer fit begins with the trees of a shorter one. So no more than
    about twice the needed rounds are fitted in the last stage, however many
    are allowed, and as many again in those before it."""
    rounds = est.getMaxIter()
    n = min(max(first, patience + 1), rounds)
    while True:
        fitted = est.copy({est.maxIter: n}).fit(train)
        loss = fitted.evaluateEachIteration(held)
        best = int(np.argmin(loss))
        if n == rounds or len(loss) - 1 - best >= patience:
            return first_trees(fitted, best + 1)
        n = min(2 * n, rounds)


def first_trees(fitted: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model of the first ``n`` rounds."""
    java = fitted._java_obj
    if n >= fitted.getNumTrees:
        return fitted
    gateway = SparkContext._active_spark_context._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    every, all_weights = java.trees(), java.treeWeights()
    for i in range(n):
        trees[i], weights[i] = every[i], all_weights[i]
    cut = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), trees, weights, java.numFeatures(), java.numClasses())
    return GBTClassificationModel(java.copyValues(cut, java.extractParamMap()))


# ---- training sets --------------------------------------------------------------

class TrainingSets(NamedTuple):
    """The sets of a scheme. Rows are written once, each with the sets that use
    it; vectors are made when a set is read."""
    members: DataFrame  # role (train), row_id, y, fold, f (raw values), uses (the sets it trains; one entry a copy), ids (the copies' row_ids, or null)
    scored: DataFrame  # role (oof, test), row_id, y, fold, f, uses (the sets that score it), ids (null)
    rows: dict  # training rows of each set
    width: dict  # features of each set
    params: DataFrame  # set, stats (what a row of the set is filled, ranged and standardised with), n, n1

    @property
    def table(self) -> DataFrame:
        """The vectors of all sets: set, role (train, oof, test), row_id, y,
        fold, weight, held, raw, ranged, standard."""
        return _vectors(_copies(self.members.unionByName(self.scored)), self.params)

    def of(self, s: int, train: bool) -> DataFrame:
        """The training rows of set ``s``, or those that it scores."""
        return _vectors(_copies(self.members if train else self.scored, s), self.params.where(F.col("set") == s))


def _copies(rows: DataFrame, s: int | None = None) -> DataFrame:
    """A row for each entry of ``uses``, or of those of set ``s``: set, and the copy's row_id."""
    def own(rows: DataFrame, entries) -> DataFrame:
        return rows.select("*", F.explode(entries if s is None else F.filter(entries, lambda e: e["set"] == F.lit(s))).alias("__e"))

    named = F.transform("uses", lambda x, i: F.struct(x.alias("set"), F.coalesce(F.get("ids", i), "row_id").alias("row_id")))
    return own(rows, named).withColumns({"set": F.col("__e.set"), "row_id": F.col("__e.row_id")}).drop("__e", "ids")


def _vectors(rows: DataFrame, params: DataFrame) -> DataFrame:
    joined = rows.join(F.broadcast(params), "set")
    raw = F.transform("stats", lambda s: F.coalesce(F.get("f", s["pos"]), s["median"]))
    return joined.withColumn("x", raw).select(
        "set", "role", "row_id", "y", "fold", F.expr("n / (2 * CASE WHEN y = 1 THEN n1 ELSE n - n1 END)").alias("weight"),
        (F.pmod(F.xxhash64("row_id", "set"), F.lit(10)) == 0).alias("held"), array_to_vector("x").alias("raw"),
        array_to_vector(F.zip_with("x", "stats", lambda x, s: F.when(s["hi"] > s["lo"], (x - s["lo"]) / (s["hi"] - s["lo"])).otherwise(0.0))).alias("ranged"),
        array_to_vector(F.zip_with("x", "stats", lambda x, s: F.when(s["sd"] > 0, (x - s["mean"]) / s["sd"]).otherwise(0.0))).alias("standard"))


def _vector_params(members: DataFrame, n: int, rows: int, width: int, counts: dict) -> DataFrame:
    """(set, stats, n, n1): the training side's (pos, median, lo, hi, mean, sd) of each
    feature that has a value, in order, for sets 0 .. n - 1. counts: set -> (n,
    n1). Rows are read as they are written and not copied for each set; what
    reaches the driver are sets x features."""
    found = columns.set_statistics(members, n, rows, width)
    stats = "array<struct<pos:int,median:double,lo:double,hi:double,mean:double,sd:double>>"
    out = [(s, [(int(j), *(float(v[j]) for v in own)) for j in np.flatnonzero(known)], *counts[s])
           for s, (known, *own) in sorted(found.items()) if s in counts and known.any()]
    return members.sparkSession.createDataFrame(out, f"set int, stats {stats}, n long, n1 long")


def _values(features: Sequence[str]):
    # one SQL text: hundreds of columns cost no round trips
    names = ["`" + c.replace("`", "``") + "`" for c in features]
    return F.expr(f"array({', '.join(f'nanvl(CAST({c} AS DOUBLE), NULL)' for c in names)})").alias("f")


def _written(rows: DataFrame, n: int, width: int, name: str) -> DataFrame:
    """role, row_id, y, fold, f, uses, ids of the rows that a set uses."""
    ids = F.col("ids") if "ids" in rows.columns else F.lit(None).cast("array<string>").alias("ids")
    out = rows.select("role", F.col("row_id").cast("string").alias("row_id"), "y", F.col("fold").cast("int").alias("fold"), "f", "uses", ids)
    return materialised(spread(out.where(F.size("uses") > 0), n, width + ROW_VALUES), name)


ROW_VALUES = 16  # what a row holds besides its features, in values


def training_sets(members: DataFrame, scored: DataFrame, features: Sequence[str], n: int, rows: tuple[int, int]) -> TrainingSets:
    """M1-M3 for the sets 0 .. n - 1 at once. members: row_id, y, f
    (``_values``), uses and, where a row stands for several, ids; scored: role,
    row_id, y, fold, f, uses; rows: how many they have."""
    train = _written(members.withColumns({"role": F.lit("train"), "fold": F.lit(None).cast("int")}), rows[0], len(features), "training-rows")
    held = _written(scored, rows[1], len(features), "scored-rows")
    # one row a set: bounded by folds, bags and features
    counts = {r["set"]: (r["n"], r["n1"]) for r in
              train.select(F.explode("uses").alias("set"), "y").groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1")).collect()}
    params = materialised(_vector_params(train, n, rows[0], len(features), counts), "training-params")
    bound = params.select("set", "n", F.size("stats").alias("width")).collect()
    return TrainingSets(train, held, {r["set"]: r["n"] for r in bound}, {r["set"]: r["width"] for r in bound}, params)


def _sequence(n: int):
    return F.sequence(F.lit(0), F.lit(n - 1))


def fold_sets(train: DataFrame, test: DataFrame, features: Sequence[str], k: int) -> TrainingSets:
    """M9: set f trains on the other folds and scores fold f and the test
    rows. train: row_id, y, fold, features; test: row_id, features."""
    n = train.count()
    members = train.select("row_id", "y", _values(features), F.filter(_sequence(k), lambda s: F.col("fold") != s).alias("uses"))
    return training_sets(members, _held_out(train, test, features, k), features, k, (n, n + test.count()))


def _held_out(train, test, features, k: int, bags: int = 1) -> DataFrame:
    """Fold f is scored by its sets f * bags .. f * bags + bags - 1, the test
    rows by all."""
    own = F.filter(_sequence(k * bags), lambda s: F.col("fold") == F.floor(s / F.lit(bags)))
    oof = train.select(F.lit("oof").alias("role"), "row_id", "y", "fold", _values(features), own.alias("uses"))
    return oof.unionByName(test.select(F.lit("test").alias("role"), "row_id", F.lit(None).cast("int").alias("y"),
                                       F.lit(None).cast("int").alias("fold"), _values(features), _sequence(k * bags).alias("uses")))


def bag_sets(train: DataFrame, test: DataFrame, draws: DataFrame, features: Sequence[str], k: int, bags: int) -> TrainingSets:
    """Set f * bags + b trains on bag b of fold f. draws: fold (held out),
    bag, row_id, y (negative_bags). A row's draws of all sets stand beside it."""
    n = train.count()
    uses = draws.groupBy("row_id", "y").agg(F.collect_list((F.col("fold") * bags + F.col("bag")).cast("int")).alias("uses"))
    members = uses.join(train.select("row_id", _values(features)), "row_id")
    return training_sets(members, _held_out(train, test, features, k, bags), features, k * bags, (n, n + test.count()))


def background_sets(train: DataFrame, test: DataFrame, absences: DataFrame, features: Sequence[str], k: int, bags: int) -> TrainingSets:
    """Set f * bags + b trains on the other folds and the pseudo-absences
    of (fold f, bag b). absences: fold, bag, ID, y, features; or draws (array
    of fold, bag, ID), y, features, where all draws of a place are one row."""
    n = train.count()
    own = F.filter(_sequence(k * bags), lambda s: F.col("fold") != F.floor(s / F.lit(bags)))
    members = train.select(F.col("row_id").cast("string").alias("row_id"), "y", _values(features), own.alias("uses"))
    if "draws" in absences.columns:
        drawn = absences.select(F.lit(None).cast("string").alias("row_id"), "y", _values(features),
                                F.transform("draws", lambda d: (d["fold"] * bags + d["bag"]).cast("int")).alias("uses"), F.col("draws.ID").alias("ids"))
        members = members.withColumn("ids", F.lit(None).cast("array<string>"))
    else:
        drawn = absences.select(F.col("ID").alias("row_id"), "y", _values(features), F.array((F.col("fold") * bags + F.col("bag")).cast("int")).alias("uses"))
    return training_sets(members.unionByName(drawn), _held_out(train, test, features, k, bags), features, k * bags,
                         (n + absences.select("y").count(), n + test.count()))


def split_set(rows: DataFrame, features: Sequence[str]) -> TrainingSets:
    """One set that trains on the rows that are not ``is_valid`` and
    scores the others. rows: row_id, y, is_valid, features."""
    n = rows.count()
    plain = rows.select("row_id", "y", "is_valid", _values(features), F.array(F.lit(0)).alias("uses"))
    held = plain.where("is_valid").withColumns({"role": F.lit("oof"), "fold": F.lit(0)})
    return training_sets(plain.where("NOT is_valid"), held, features, 1, (n, n))


# ---- fits -----------------------------------------------------------------------

def _training_rows(rows: DataFrame, model: Model) -> DataFrame:
    columns = [F.col(model.vectors).alias("features"), F.col("y").cast("double").alias("label"), "weight", "held"]
    out = rows.select(*columns)
    if model.repeat:
        least = out.agg(F.min("weight")).first()[0]
        out = out.select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.round(F.col("weight") / F.lit(least)).cast("int")))).alias("copy"))
    return out


CELLS_PER_TASK = 2_000_000  # values of a training set that one task reads in each pass of a fit


def fit_set(model: Model, sets: TrainingSets, s: int):
    """The model fitted on a set. An iterative fit runs hundreds of short jobs,
    so its rows lie in as few tasks as their number of values asks for, and are
    kept. A forest reads them three times, and keeps them in a form of its own:
    a set that would not fit into the executors' memory is not kept twice."""
    tasks = max(1, -(-sets.rows[s] * sets.width[s] // CELLS_PER_TASK))
    rows = _training_rows(sets.of(s, True), model)
    est = model.make(sets.rows[s], sets.width[s]).setFeaturesCol("features").setLabelCol("label")
    rows = rows.coalesce(tasks)
    kept = not isinstance(est, RandomForestClassifier) or sets.rows[s] * sets.width[s] <= FIT_VALUES
    if kept:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if model.patience and not rows.where("held").isEmpty():
            return staged_boosting(est, rows.where("NOT held"), rows.where("held"), model.patience)
        return est.fit(rows)
    finally:
        if kept:
            rows.unpersist()


def _scored(fitted, rows: DataFrame, model: Model) -> DataFrame:
    out = fitted.transform(rows.withColumn("features", F.col(model.vectors)))
    return out.select(F.col("role").alias("split"), "row_id", "y", "fold", vector_to_array(F.col("probability"))[1].alias("p"))


FIT_WORKERS = 8
FIT_VALUES = 500_000_000  # of the training sets that are fitted, and kept, at a time


def fit_workers(sets: TrainingSets, workers: int = FIT_WORKERS) -> int:
    """How many fits run together: each keeps the vectors of its set, so large
    sets, which fill the executors one by one, are fitted with fewer others."""
    largest = max((sets.rows[s] * sets.width[s] for s in sets.rows), default=1)
    return max(1, min(workers, FIT_VALUES // max(1, largest)))


def all_predictions(models: dict[str, Model], sets: TrainingSets, workers: int = FIT_WORKERS, with_trees: bool = False) -> DataFrame:
    """A23 for several models: every (model, set) is one fit, all of them from
    one pool of jobs; each fit scores its set's held-out rows, and rows that
    several sets score (bags, test rows) get the mean. ``with_trees``: also
    n_trees, the fewest trees of the fits that scored a row."""
    def one(job):
        name, s = job
        fitted = fit_set(models[name], sets, s)
        trees = fitted.getNumTrees if hasattr(fitted, "getNumTrees") else 0
        return _scored(fitted, sets.of(s, False), models[name]).withColumns({"n_trees": F.lit(trees), "candidate": F.lit(name)})

    jobs = [(name, s) for s in sorted(sets.rows) for name in models]
    with ThreadPoolExecutor(max_workers=fit_workers(sets, workers)) as pool:
        parts = list(pool.map(one, jobs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy("candidate", "split", "row_id", "y", "fold").agg(F.avg("p").alias("p"), F.min("n_trees").alias("n_trees"))
    return out if with_trees else out.drop("n_trees")


def set_predictions(name: str, model: Model, sets: TrainingSets, workers: int = FIT_WORKERS, with_trees: bool = False) -> DataFrame:
    """A23 for one model."""
    return all_predictions({name: model}, sets, workers, with_trees)


def fold_f1(preds: DataFrame, threshold: float = 0.5) -> DataFrame:
    """M9: the F1 of each candidate's held-out folds."""
    hit = F.col("p") >= threshold
    positive = F.col("y") == 1
    g = preds.where("split = 'oof'").groupBy("candidate", "fold").agg(
        F.count_if(positive & hit).alias("tp"), F.count_if(~positive & hit).alias("fp"), F.count_if(positive & ~hit).alias("fn"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return g.select("candidate", "fold", F.when(den > 0, 2.0 * F.col("tp") / den).otherwise(0.0).alias("f1_at_0_50"))


# ---- saved ensembles --------------------------------------------------------------

def save_fold_models(model: Model, train: DataFrame, features: Sequence[str], k: int, path: str, sets: TrainingSets | None = None) -> list[str]:
    """M15 (write side): per fold one pipeline that imputes, scales, assembles
    and predicts from the plain feature columns."""
    sets = sets or fold_sets(train, train.limit(0).select("row_id", *features), features, k)
    stats_of = {r["set"]: r["stats"] for r in sets.params.where(F.col("set") < k).collect()}  # folds x features

    def one(f: int) -> str:
        columns = []
        for i, s in enumerate(stats_of[f]):
            c = f"CASE WHEN isnan(`{features[s['pos']]}`) THEN NULL ELSE `{features[s['pos']]}` END"
            x = f"coalesce(CAST({c} AS DOUBLE), {s['median']!r}D)"
            if model.vectors == "ranged":
                x = f"({x} - {s['lo']!r}D) / {s['hi'] - s['lo']!r}D" if s["hi"] > s["lo"] else "0.0D"
            elif model.vectors == "standard":
                x = f"({x} - {s['mean']!r}D) / {s['sd']!r}D" if s["sd"] > 0 else "0.0D"
            columns.append(f"{x} AS `__x{i}`")
        prepare = SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")
        join = VectorAssembler(inputCols=[f"__x{i}" for i in range(len(columns))], outputCol="features")
        pipeline = Pipeline(stages=[prepare, join]).fit(train)
        PipelineModel([*pipeline.stages, fit_set(model, sets, f)]).write().overwrite().save(f"{path}/fold_{f}")
        return f"{path}/fold_{f}"

    with ThreadPoolExecutor(max_workers=fit_workers(sets)) as pool:
        return list(pool.map(one, range(k)))


def save_ensemble(models: dict[str, Model], train: DataFrame, features: Sequence[str], k: int, out: str, threshold: float) -> None:
    """M15 (write side) for several models: the folds' pipelines of each below
    ``out``, and a summary that names them in order."""
    spark = train.sparkSession
    sets = fold_sets(train, train.limit(0).select("row_id", *features), features, k)
    for name, model in models.items():
        save_fold_models(model, train, features, k, f"{out}/models/{name}", sets)
    store.write_json(spark, f"{out}/ensemble_summary.json", {"selected_model_names": list(models), "folds": k, "feature_columns": list(features),
                                                            "best_threshold": float(threshold)})


def score_ensemble(out: str, rows: DataFrame) -> tuple[DataFrame, float]:
    """M15 (read side) for the models that the summary names: folds are
    averaged within a model, then models. (row_id, p) and the threshold."""
    spark = rows.sparkSession
    summary = store.read_json(spark, f"{out}/ensemble_summary.json")
    names = summary["selected_model_names"]
    if not names:
        raise FileNotFoundError(f"no saved models are named in {out}")
    missing = [c for c in summary["feature_columns"] if c not in rows.columns]
    if missing:
        raise ValueError(f"rows lack features of the saved models: {missing[:5]}")
    each = None
    for name in names:
        one = score_saved([f"{out}/models/{name}/fold_{f}" for f in range(int(summary["folds"]))], rows, name)
        each = one if each is None else each.unionByName(one)
    return each.groupBy("row_id").agg((F.sum("p") / F.lit(len(names))).alias("p")), float(summary["best_threshold"])


def score_saved(paths: Sequence[str], rows: DataFrame, name: str) -> DataFrame:
    """M15 (read side): load each fold's pipeline, score, average over folds."""
    out = None
    for p in paths:
        one = PipelineModel.load(p).transform(rows).select("row_id", vector_to_array(F.col("probability"))[1].alias("p"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("row_id").agg(F.avg("p").alias("p")).withColumn("candidate", F.lit(name))
