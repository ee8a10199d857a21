"""Medians, ranges and deviations of overlapping sets against NumPy."""
import numpy as np
import pytest

from gridlab.operators import columns, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.RandomState(4)
    n = 3000
    x = np.column_stack([rng.randn(n), np.exp(6 * rng.randn(n)), rng.randint(0, 3, n), np.full(n, 7.5), rng.randn(n) + 1e9,
                         np.where(rng.rand(n) < 0.5, -1e300, 1e300), np.full(n, np.nan), np.where(rng.rand(n) < 0.7, np.nan, rng.rand(n))])
    x[0, 0], x[1, 0], x[5, 2] = np.inf, -np.inf, -0.0
    uses = [[s for s in range(4) for _ in range(rng.randint(0, 3))] if i % 7 else [] for i in range(n)]
    data = [(f"r{i}", [None if np.isnan(v) else float(v) for v in x[i]], uses[i]) for i in range(n)]
    df = spark.createDataFrame(data, "row_id string, f array<double>, uses array<int>").repartition(5).cache()
    return x, uses, df


@pytest.mark.parametrize("left", [10**9, 2000, 0])
def test_set_statistics(rows, monkeypatch, left):
    x, uses, df = rows
    monkeypatch.setattr(columns, "LEFT", left)
    monkeypatch.setattr(columns, "GUESS", 300)
    monkeypatch.setattr(columns, "BLOCK", 4000)
    got = columns.set_statistics(df, 5, len(x), x.shape[1])
    assert set(got) == {0, 1, 2, 3}  # nothing uses set 4
    for s, (known, median, lo, hi, mean, sd) in got.items():
        own = np.concatenate([np.repeat(x[i:i + 1], uses[i].count(s), axis=0) for i in range(len(x))])
        assert list(known) == [True] * 6 + [False, True]
        for j in (0, 1, 2, 3, 4, 5, 7):
            v = np.sort(own[:, j][~np.isnan(own[:, j])])
            mid = 0.5 * (len(v) - 1)
            a, b = v[int(np.floor(mid))], v[int(np.ceil(mid))]
            assert median[j] == a + (b - a) * (mid - np.floor(mid)), (s, j)
            assert (lo[j], hi[j]) == (v[0], v[-1])
            if j in (1, 2, 3, 7):
                filled = np.where(np.isnan(own[:, j]), median[j], own[:, j])
                assert np.isclose(mean[j], filled.mean(), rtol=1e-12) and np.isclose(sd[j], filled.std(), rtol=1e-6, atol=1e-6)


def test_values_are_not_written_one_by_one(spark, monkeypatch):
    """A table of (feature, value) rows is as large as all rows where values are distinct."""
    train = spark.createDataFrame([(i, i % 2, i % 3, float(i)) for i in range(30)], "row_id int, y int, fold int, a double")
    written = []
    kept = models.materialised
    monkeypatch.setattr(models, "materialised", lambda df, name, *more: written.append(df.columns) or kept(df, name, *more))
    sets = models.fold_sets(train, train.select("row_id", "a"), ["a"], 3)
    assert not any("value" in c or "pos" in c for c in written)
    stats = {r["set"]: r["stats"][0] for r in sets.params.collect()}
    assert {s: r["median"] for s, r in stats.items()} == {s: float(np.median([i for i in range(30) if i % 3 != s])) for s in range(3)}
