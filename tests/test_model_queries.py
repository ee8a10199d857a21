"""What the registered model queries ask of their plans."""
from gridlab.config import ModelParams
from gridlab.operators import models
from gridlab.plans import queries_models as qm


def test_model_suite_fits_the_full_sizes(spark, monkeypatch, tmp_path):
    asked = {}

    def run_suite(tr, ts, feats, params, **more):
        asked.update(params=params, **more)
        return spark.range(1).select("id"), {}

    monkeypatch.setattr(qm, "_model_tables", lambda spark, sf_dir: (None, None, ["a"], None))
    monkeypatch.setattr(qm, "_absences", lambda *a: "absences")
    monkeypatch.setattr(qm.suite, "run_suite", run_suite)
    assert qm.q_model_suite(spark, str(tmp_path)).count() == 1
    assert asked["params"] == ModelParams() and asked["absences"] == "absences" and "base_models" not in asked and "variants" not in asked
    reg = models.registry(asked["params"])
    full = ModelParams().sizes
    assert reg["boosted_trees"].make(10, 2).getMaxIter() == full.boosted_trees.rounds
    assert reg["extra_trees"].make(10, 2).getNumTrees() == full.trees and reg["extra_trees"].make(10, 2).getMaxDepth() == full.tree_depth
    assert reg["dense_mlp"].make(10, 2).getLayers() == [2, *full.hidden, 2]
