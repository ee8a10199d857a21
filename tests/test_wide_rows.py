"""Steps that made wide rows in one task, and training rows copied for each set."""
import numpy as np

from gridlab.operators import models
from gridlab.session import spread


def test_wide_rows_are_dealt_out(spark):
    one = spark.range(40_000).coalesce(1)
    assert spread(one, 40_000, 1000).rdd.getNumPartitions() == 10
    assert spread(one, 40_000, 10).rdd.getNumPartitions() == 1


def test_rows_are_written_once_for_all_sets(spark):
    rows = spark.createDataFrame([(i, i % 2, i % 5, float(i)) for i in range(100)], "row_id int, y int, fold int, a double")
    test = spark.createDataFrame([(1000, 1.0)], "row_id int, a double")
    draws = spark.createDataFrame([(f, b, i, i % 2) for f in range(5) for b in range(2) for i in range(100) if i % 5 != f for _ in range(1 + b)],
                                  "fold int, bag int, row_id int, y int")
    sets = models.bag_sets(rows, test, draws, ["a"], 5, 2)
    assert sets.members.count() == 100 and sets.scored.count() == 101
    assert sets.rows == {f * 2 + b: 80 * (1 + b) for f in range(5) for b in range(2)}
    for s in (0, 7):
        own = [r["row_id"] for r in sets.of(s, True).collect()]
        assert sorted(own) == sorted(str(i) for i in range(100) if i % 5 != s // 2 for _ in range(1 + s % 2))
        assert {r["row_id"] for r in sets.of(s, False).collect()} == {"1000", *(str(i) for i in range(100) if i % 5 == s // 2)}
    assert sets.table.where("role = 'train'").count() == sum(sets.rows.values())
    stats = {r["set"]: r["stats"][0] for r in sets.params.collect()}
    for s in sets.rows:
        own = [i for i in range(100) if i % 5 != s // 2]
        assert stats[s]["median"] == np.median(own) and abs(stats[s]["mean"] - np.mean(own)) < 1e-9 and (stats[s]["lo"], stats[s]["hi"]) == (own[0], own[-1])
    assert models.fit_workers(sets) == models.FIT_WORKERS
    assert models.fit_workers(sets._replace(rows={0: models.FIT_VALUES}, width={0: 1})) == 1
