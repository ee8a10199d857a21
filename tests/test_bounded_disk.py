"""Copies and files that grew faster than the rows."""
import numpy as np
from pyspark.sql import functions as F

from gridlab.config import SMALL_MODELS
from gridlab.operators import knn, models
from gridlab.plans import queries_models as qm
from gridlab.session import materialised


def test_references_are_copied_for_their_own_visitors(spark, monkeypatch):
    rng = np.random.RandomState(5)
    groups = 5
    a, b = rng.randn(2000, 3), rng.randn(1500, 3)
    ca = spark.createDataFrame([(i % groups, i, v.tolist()) for i, v in enumerate(a)], "g int, k long, v array<double>")
    cb = spark.createDataFrame([(i % groups, i, v.tolist()) for i, v in enumerate(b)], "g int, r long, v array<double>")
    met = spark.sparkContext.accumulator(0)
    solve = knn._solve_block

    def counted(key, gs):
        inner = solve(key, gs)

        def fn(left, right):
            met.add(len(right))
            return inner(left, right)
        return fn

    monkeypatch.setattr(knn, "_solve_block", counted)
    got = {r["k"]: r["dist"] for r in knn.nearest_distance(ca, cb, "k", "v", "v", "r", ["g"], pivots=8, block=400).collect()}
    for i in range(2000):
        assert abs(got[i] - np.sqrt(((b[np.arange(1500) % groups == i % groups] - a[i]) ** 2).sum(1)).min()) < 1e-12
    assert 0 < met.value <= 2 * 1500  # 400 candidates a group are one block


def test_shuffle_files_of_a_written_table_go(spark):
    def files():
        every = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {every.apply(i).getName() for i in range(every.size()) if every.apply(i).getName().startswith("shuffle_")}

    before = files()
    t = materialised(spark.range(10_000).groupBy((F.col("id") % 7).alias("g")).count().repartition(3), "grouped")
    assert not files() - before
    assert t.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_draws_of_a_place_are_one_row(spark, monkeypatch):
    """Wide features are written for each place; sets, copies and row ids are those of single rows."""
    train = spark.createDataFrame([(i, i % 2, i % 2, float(i)) for i in range(40)], "row_id int, y int, fold int, a double")
    test = spark.createDataFrame([(1000, 1.0)], "row_id int, a double")
    rng = np.random.RandomState(7)
    data = [(f, b, float(rng.randint(0, 4)), 0.0, f"PA_{f}_{b}_{j}", 0) for f in range(2) for b in range(3) for j in range(50)]
    sel = spark.createDataFrame(data, "fold int, bag int, Latitude double, Longitude double, ID string, y int")
    single = models.background_sets(train, test, sel.withColumn("a", F.col("Latitude") / 3), ["a"], 2, 3)
    for draws in (qm.DRAWS, 10):
        monkeypatch.setattr(qm, "DRAWS", draws)
        places = qm.places_drawn(sel, len(data))
        assert places.count() == 4 if draws == qm.DRAWS and draws > 300 else places.count() > 4
        sets = models.background_sets(train, test, places.withColumn("a", F.col("Latitude") / 3), ["a"], 2, 3)
        assert sets.members.count() == 40 + places.count() and sets.rows == single.rows
        for s in (0, 4):
            a, b = (sorted(map(str, x.of(s, True).collect())) for x in (sets, single))
            assert a == b
        assert sets.table.count() == single.table.count()


def test_a_large_forest_set_is_not_kept_twice(spark, monkeypatch):
    train = spark.createDataFrame([(i, i % 2, i % 2, float(i)) for i in range(40)], "row_id int, y int, fold int, a double")
    sets = models.fold_sets(train, train.select("row_id", "a"), ["a"], 2)
    kept = []
    monkeypatch.setattr(type(train), "persist", lambda self, *a: kept.append(1) or self)
    monkeypatch.setattr(type(train), "unpersist", lambda self, *a: self)
    forest = models.forest(3, SMALL_MODELS, 1, "0.6", 1)
    models.fit_set(forest, sets, 0)
    monkeypatch.setattr(models, "FIT_VALUES", 10)
    fitted = models.fit_set(forest, sets, 0)
    assert kept == [1] and fitted.getNumTrees == 3
