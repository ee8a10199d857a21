"""The candidate suite and post-hoc generation against plain recomputation."""
import numpy as np
import pytest

from gridlab.config import Boosting, Ensembles, ModelParams, ModelSizes, focus_grid, optimize_grid, public_grid
from gridlab.plans import posthoc, suite
from gridlab.sources import store

PARAMS = ModelParams(folds=2, seeds=(), sizes=ModelSizes(50, Boosting(2, 2, 0.3), Boosting(2, 2, 0.3), Boosting(2, 2, 0.3), 5, 5, 3, (4,), 10),
                     ensembles=Ensembles(diverse=3, stacked=3, calibrated=2))


def f1(y, p, t):
    hit = p >= t
    den = 2 * (y & hit).sum() + (~y & hit).sum() + (y & ~hit).sum()
    return 2 * (y & hit).sum() / den if den else 0.0


def best(y, p, grid):
    scores = [f1(y, p, t) for t in grid]
    return grid[int(np.argmax(scores))], max(scores)


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(90):
        y = int(rng.random() < 0.4)
        rows.append((f"r{i}", y, i % 2, f"g{i % 9}", float(rng.normal() + y), float(rng.normal() - y) if i % 6 else None))
    train = spark.createDataFrame(rows, "row_id string, y int, fold int, grp string, a double, b double")
    test = train.where("fold = 0").selectExpr("concat('t', row_id) AS row_id", "a", "b").limit(20)
    out = str(tmp_path_factory.mktemp("suite"))
    table, record = suite.run_suite(train, test, ["a", "b"], PARAMS, base_models=("logistic_regression", "boosted_trees", "extra_trees"),
                                    variants=("extra_trees",), output_dir=out)
    return {r["candidate"]: r for r in table.collect()}, record, out


def test_members_come_from_the_base_pool(run):
    table, record, _ = run
    base = {n for n, r in table.items() if r["method"] in ("base", "negative_bagged")}
    assert base == {"logistic_regression", "boosted_trees", "extra_trees", "extra_trees_negative_bagged"}
    for r in table.values():
        if r["method"] in ("mean", "weighted", "rank", "stack"):
            assert set(r["members"]) <= base and len(r["members"]) >= 2
    assert {len(r["members"]) for r in table.values() if r["method"] == "weighted"} == {2, 3}
    calibrated = {r["members"][0] for r in table.values() if r["method"].startswith("calibrated")}
    assert len(calibrated) == 2 and all(f"{n}_cal_{m}" in table for n in calibrated for m in ("sigmoid", "isotonic"))
    first = min(table.values(), key=lambda r: (-r["oof_f1"], r["build_order"]))
    assert record["best_model_name"] == first["candidate"]


def test_scores_and_artifacts_follow_the_predictions(spark, run):
    table, record, out = run
    grid = optimize_grid(PARAMS)
    preds = store.read_probability_artifacts(spark, f"{out}/models").toPandas()
    assert set(preds["candidate"]) == set(table)
    for name, own in preds.groupby("candidate"):
        oof = own[own["split"] == "oof"]
        assert len(oof) == 90 and oof["row_id"].is_unique and own[own["split"] == "test"]["row_id"].nunique() == 20
        assert own["p"].between(0, 1).all()
        t, score = best(oof["y"].to_numpy() == 1, oof["p"].to_numpy(), grid)
        assert t == table[name]["threshold"] and abs(score - table[name]["oof_f1"]) < 1e-12
    means = preds[preds["candidate"] == "ensemble_mean_top2"].set_index(["split", "row_id"])["p"]
    parts = [preds[preds["candidate"] == m].set_index(["split", "row_id"])["p"] for m in table["ensemble_mean_top2"]["members"]]
    assert np.allclose(means, (parts[0] + parts[1]).reindex(means.index) / 2)
    summary = store.read_json(spark, f"{out}/baseline_summary.json")
    assert summary["best_model_name"] == record["best_model_name"] and set(summary["models"]) == set(table)
    assert len(summary["models"]["logistic_regression"]["fold_rows"]) == 2 and 0 <= summary["benchmark"]["f1_at_0_50"] <= 1
    assert store.read_json(spark, f"{out}/metrics/extra_trees_metrics.json")["threshold"] == table["extra_trees"]["threshold"]
    assert suite.load_summary(spark, out)["threshold"] == record["threshold"]
    sub = spark.read.option("header", True).csv(f"{out}/final_submission")
    assert sub.count() == 20 and set(r[0] for r in sub.select("Target").distinct().collect()) <= {"0", "1"}


def test_posthoc_candidates(spark):
    """Pair blends are the best of nine weights, cross blends take a fifth of
    the neural candidate, and all records follow from the predictions."""
    rng = np.random.default_rng(2)
    y = rng.random(120) < 0.4
    rows = []
    for c, noise in (("b0", 0.8), ("b1", 1.0), ("n0", 0.9)):
        p = 1 / (1 + np.exp(-(2 * y - 1 + rng.normal(size=120) * noise)))
        rows += [(c, "oof", i, int(y[i]), float(p[i])) for i in range(120)] + [(c, "test", 1000 + i, None, float(p[i])) for i in range(20)]
    preds = spark.createDataFrame(rows, "candidate string, split string, row_id int, y int, p double")
    ranked, long = posthoc.posthoc(preds, ["b0", "b1"], ["n0"], None, 0.4, PARAMS, max_candidates=50)
    records = {r["candidate"]: r for r in ranked.collect()}
    data = long.where("split = 'oof'").toPandas()
    grid = public_grid(PARAMS)
    focus = focus_grid(grid, PARAMS)

    def record(p):
        scores = [f1(y, p, t) for t in focus]
        return (max(scores), float(np.mean(scores)), best(y, p, grid)[1])

    source = {c: preds.where(f"candidate = '{c}' AND split = 'oof'").orderBy("row_id").toPandas()["p"].to_numpy() for c in ("b0", "b1", "n0")}
    for name, own in data.groupby("candidate"):
        if name.startswith("prior_shift"):
            continue
        got = record(own.sort_values("row_id")["p"].to_numpy())
        assert np.allclose(got, [records[name][k] for k in posthoc.KEY])
    blends = [n for n in records if n.startswith("blend_")]
    assert len(blends) == 1 and sum(n.startswith("rank_") for n in records) == 1
    a, b = next(c for c in (("b0", "b1"), ("b1", "b0")) if blends[0].startswith(f"blend_{c[0]}_"))
    every = [record(w * source[a] + (1 - w) * source[b]) for w in np.arange(0.1, 1.0, 0.1)]
    assert np.allclose(max(every), [records[blends[0]][k] for k in posthoc.KEY])
    crosses = [n for n in records if n.startswith("cross_")]
    assert len(crosses) == 2 and all(n.endswith("__n0_0.2") for n in crosses)
    order = [tuple(-records[n][k] for k in posthoc.KEY) for n in sorted(records, key=lambda n: records[n]["rank"])]
    assert order == sorted(order)
