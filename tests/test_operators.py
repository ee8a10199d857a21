"""Edge fixtures and brute-force checks."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlab.config import focus_grid, optimize_grid, public_grid
from gridlab.config import CubeSpec, FeatureParams
from gridlab.functions.scalar import bucket_index, f1_from_counts, safe_ratio, spatial_block
from gridlab.operators import focal, metrics, nearest, split, temporal
from gridlab.operators.calibrate import prior_shift
from gridlab.operators.knn import nearest_distance
from gridlab.operators.ordering import global_row_number, group_row_number, group_running_sum


def test_threshold_grids():
    assert len(optimize_grid()) == 81
    g = public_grid()
    assert len(g) == 21 and len(focus_grid(g)) == 13


def test_safe_ratio_and_blocks(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (-30.2, 0.5)], "a double, b double")
    r = df.select(safe_ratio("a", "b").alias("r"), spatial_block("a", "b", 0.5).alias("g")).collect()
    assert r[0].r is None and r[1].r == 0.5
    assert r[2].g == "-61_1"


def test_bucket_index_matches_count(spark):
    grid = optimize_grid()
    vals = [0.0, 0.1, 0.5, 0.55, 0.9, 0.95, 0.8999999999999996, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    got = [r.b for r in df.select(bucket_index(F.col("p"), grid).alias("b")).collect()]
    assert got == [sum(t <= v for t in grid) for v in vals]


def _cube(spark, rows, n_time, variables=("v",)):
    cols = "lat_idx int, lon_idx int, time_idx int, lat double, lon double, month date, " + \
        ", ".join(f"{v} double" for v in variables)
    return spark.createDataFrame(rows, cols)


def test_run_length_spells(spark):
    import datetime as dt
    vals = [1.0, 1.0, -1.0, 1.0, None]        # T T F T NULL -> 2
    rows = [(0, 0, t, 0.0, 0.0, dt.date(2020, t + 1, 1), v) for t, v in enumerate(vals)]
    rows += [(0, 1, t, 0.0, 1.0, dt.date(2020, t + 1, 1), -1.0) for t in range(5)]  # no true -> 0
    c = _cube(spark, rows, 5)
    out = {(r.lat_idx, r.lon_idx): r.s for r in temporal.longest_spell(c, F.col("v") > 0, "s").collect()}
    assert out == {(0, 0): 2, (0, 1): 0}


def test_all_null_cell_and_single_month(spark):
    import datetime as dt
    rows = [(0, 0, t, 0.0, 0.0, dt.date(2020, t + 1, 1), None) for t in range(4)]
    rows += [(0, 1, t, 0.0, 1.0, dt.date(2020, t + 1, 1), 5.0 if t == 2 else None) for t in range(4)]
    c = _cube(spark, rows, 4)
    s = {(r.lat_idx, r.lon_idx): r for r in temporal.cell_statistics(c, ["v"], temporal.STAT_PARTS,
                                                                      n_time=4, last_n=2).collect()}
    assert s[(0, 0)].v_mean is None and s[(0, 0)].v_trend is None
    assert s[(0, 1)].v_std == 0.0 and s[(0, 1)].v_trend is None and s[(0, 1)].v_cv == 0.0


def test_focal_matches_brute_force(spark):
    rng = random.Random(3)
    n_lat, n_lon = 6, 5
    vals = {(i, j): (None if rng.random() < 0.15 else rng.uniform(-5, 5)) for i in range(n_lat) for j in range(n_lon)}
    df = spark.createDataFrame([(i, j, v) for (i, j), v in vals.items()], "lat_idx int, lon_idx int, v_median double")
    got = {(r.lat_idx, r.lon_idx): r for r in focal.focal_stats(df, ["v"], (3, 5)).collect()}
    for (i, j), v in vals.items():
        for k in (3, 5):
            r = (k - 1) // 2
            win = [vals[(a, b)] for a in range(i - r, i + r + 1) for b in range(j - r, j + r + 1)
                   if (a, b) in vals and vals[(a, b)] is not None]
            g = got[(i, j)]
            if not win:
                assert getattr(g, f"v_local_mean_w{k}") is None
                continue
            assert math.isclose(getattr(g, f"v_local_mean_w{k}"), np.mean(win), abs_tol=1e-9)
            assert math.isclose(getattr(g, f"v_local_std_w{k}"), np.std(win), abs_tol=1e-7)
            assert math.isclose(getattr(g, f"v_local_range_w{k}"), max(win) - min(win), abs_tol=1e-9)
            c = getattr(g, f"v_local_contrast_w{k}")
            assert (c is None) if v is None else math.isclose(c, v - np.mean(win), abs_tol=1e-9)


def test_nearest_cell_ties_and_clamp(spark):
    pts = spark.createDataFrame([(0.5, -3.0), (1.49, 20.0), (2.5, 1.5)], "Latitude double, Longitude double")
    out = nearest.nearest_cell_index(pts, [0.0, 1.0, 2.0, 3.0], [0.0, 1.0, 2.0]).collect()
    got = [(r.lat_idx, r.lon_idx) for r in out]
    assert got == [(1, 0), (1, 2), (3, 2)]   # midpoint -> larger coordinate; outside -> edge


def test_many_to_one_guard(spark):
    right = spark.createDataFrame([(1.0, 2.0, 1), (1.0, 2.0, 2)], "Latitude double, Longitude double, f int")
    with pytest.raises(ValueError):
        nearest.assert_many_to_one(right, ["Latitude", "Longitude"])


def test_threshold_sweep_against_explode(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    p = np.round(rng.random(300), 2)
    df = spark.createDataFrame([("a", int(a), float(b)) for a, b in zip(y, p)], "candidate string, y int, p double")
    grid = optimize_grid()
    sw = {r.i: r for r in metrics.threshold_sweep(df, grid).collect()}
    for i, t in enumerate(grid):
        pred = p >= t
        tp, fp, fn = int((pred & (y == 1)).sum()), int((pred & (y == 0)).sum()), int((~pred & (y == 1)).sum())
        assert (sw[i].tp, sw[i].fp, sw[i].fn) == (tp, fp, fn)


def test_best_threshold_tie_takes_lower(spark):
    df = spark.createDataFrame([("a", 1, 0.95), ("a", 0, 0.05)], "candidate string, y int, p double")
    b = metrics.best_threshold(metrics.threshold_sweep(df, optimize_grid())).first()
    assert b.oof_f1 == 1.0 and abs(b.threshold - 0.1) < 1e-12


def test_f1_no_positives_is_zero(spark):
    r = spark.range(1).select(f1_from_counts(F.lit(0), F.lit(0), F.lit(0)).alias("f")).first()
    assert r.f == 0.0


def test_constant_candidate_corr_is_one(spark):
    df = spark.createDataFrame([("a", i, 0.5) for i in range(5)] + [("b", i, i / 5) for i in range(5)],
                               "candidate string, row_id int, p double")
    r = metrics.candidate_corr(df, ["a", "b"]).first()
    assert r.corr == 1.0


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_row_numbers_have_no_gaps_on_wide_rows(spark, coalesce):
    """1..n without gaps on 2 M wide rows over many sort partitions, with and
    without coalescing, though the result is evaluated several times."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        n = 2_000_000
        df = spark.range(0, n, 1, 16).select(F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3).alias("g"),
                                             F.rand(7).alias("x"), "id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
        r = global_row_number(df, ["x", "id"], "rn")
        one = F.struct(F.min("rn"), F.max("rn"), F.count(F.lit(1)), F.countDistinct("rn"))
        assert tuple(r.select(one).first()[0]) == (1, n, n, n)
        g = group_row_number(df, ["g"], ["x", "id"], "rn", with_count=True)
        for row in g.groupBy("g").agg(one.alias("s"), F.min("rn_n").alias("lo"), F.max("rn_n").alias("hi")).collect():
            assert row.s[0] == 1 and row.s[1] == row.s[2] == row.s[3] == row.lo == row.hi
        late = g.where("rn > 1").alias("a").join(g.alias("b"), F.expr("a.g = b.g AND a.rn = b.rn + 1 AND a.x < b.x"))
        assert late.where("a.id % 1000 = 1").count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_running_sums(spark):
    rng = np.random.default_rng(8)
    rows = [(int(g), float(np.round(x, 1)), i, int(w)) for i, (g, x, w) in
            enumerate(zip(rng.integers(0, 4, 500), rng.normal(size=500), rng.integers(0, 9, 500)))]
    df = spark.createDataFrame(rows, "g int, x double, id int, w int").repartition(5)
    got = {r.id: (r.upto, r.total) for r in group_running_sum(df, ["g"], ["x", "id"], "w", "upto", "total").collect()}
    for g in range(4):
        own = sorted((x, i, w) for gg, x, i, w in rows if gg == g)
        total, upto = sum(w for _, _, w in own), 0
        for _, i, w in own:
            upto += w
            assert got[i] == (upto, total)


def test_group_folds_disjoint(spark):
    rows = spark.createDataFrame([(f"g{i % 23}", i % 2) for i in range(400)], "grp string, y int")
    f = split.group_folds(rows, "grp", "y", 5, 42)
    got = f.collect()
    assert len({r.grp for r in got}) == 23 and {r.fold for r in got} == set(range(5))


def test_nearest_distance_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(60, 4)), rng.normal(size=(25, 4))
    ca = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "k long, v array<double>")
    cb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "rk long, v array<double>")
    got = {r.k: r.dist for r in nearest_distance(ca, cb, "k", "v", "v", "rk", block=8).collect()}
    for i, v in enumerate(a):
        assert math.isclose(got[i], np.sqrt(((b - v) ** 2).sum(1)).min(), rel_tol=1e-12)


def test_pruned_search_is_exact(spark):
    """Clustered vectors far from the origin, cells of several blocks, groups
    with and without references; and far cells are left out."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 5)) * 50 + 1e6
    a, b = (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 5)) for n in (900, 700))
    ga, gb = rng.integers(0, 3, 900), rng.integers(0, 2, 700)
    ca = spark.createDataFrame([(int(g), i, v.tolist()) for i, (g, v) in enumerate(zip(ga, a))], "g int, k long, v array<double>")
    cb = spark.createDataFrame([(int(g), i, v.tolist()) for i, (g, v) in enumerate(zip(gb, b))], "g int, rk long, v array<double>")
    got = {r.k: r.dist for r in nearest_distance(ca, cb, "k", "v", "v", "rk", ["g"], pivots=16, block=64).collect()}
    for i in range(900):
        if ga[i] == 2:
            assert got[i] is None
        else:
            assert math.isclose(got[i], np.sqrt(((b[gb == ga[i]] - a[i]) ** 2).sum(1)).min(), rel_tol=1e-12)


def test_prior_shift_matches_numpy(spark):
    p = np.array([0.1, 0.4, 0.35, 0.8, 0.9, 0.2])
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(p)], "candidate string, row_id int, p double")
    adj, fin = prior_shift(df, 0.7)
    s, t = 0.7, 0.7
    base = np.clip(p, 1e-6, 1 - 1e-6)
    for _ in range(100):
        num = base * (t / s)
        a = np.clip(num / (num + (1 - base) * ((1 - t) / (1 - s))), 1e-6, 1 - 1e-6)
        u = a.mean()
        if abs(u - t) <= 1e-6:
            t = u
            break
        t = float(np.clip(u, 1e-4, 1 - 1e-4))
    got = np.array([r.p for r in adj.orderBy("row_id").collect()])
    assert np.allclose(got, a, atol=1e-9) and abs(fin["a"] - t) < 1e-9


def test_exact_quantiles_of_columns_and_groups(spark):
    from gridlab.operators.quantile import exact_quantiles, quantile_table
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 3)), float(np.round(rng.normal(), 1)) if rng.random() > 0.1 else None, float(i)) for i in range(999)]
    df = spark.createDataFrame([(*r, None) for r in rows], "g int, x double, z double, none double").repartition(5)
    qs = [0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["x", "z", "none"], qs)
    assert got["none"] == [None] * len(qs)
    assert np.allclose(got["x"], np.quantile([x for _, x, _ in rows if x is not None], qs), atol=1e-12)
    for r in quantile_table(df, ["x", "z"], qs, ["g"]).collect():
        own = [x if r.column == "x" else z for g, x, z in rows if g == r.g and (r.column == "z" or x is not None)]
        assert r.n == len(own) and np.allclose([r[f"q{i}"] for i in range(len(qs))], np.quantile(own, qs), atol=1e-12)


def test_diverse_selection_equals_greedy_choice():
    rng = np.random.default_rng(3)
    for _ in range(200):
        names = [f"c{i}" for i in range(rng.integers(1, 9))]
        corr = {(a, b): float(rng.uniform(-1, 1)) for i, a in enumerate(names) for b in names[i + 1:] if rng.random() < 0.9}
        k, limit = int(rng.integers(1, 9)), float(rng.uniform(0.2, 1))
        taken = []
        for n in names:  # greedy, then back-filled in rank order
            if len(taken) < k and all(abs(corr.get((t, n), corr.get((n, t), 1.0))) < limit for t in taken):
                taken.append(n)
        taken += [n for n in names if n not in taken][:max(0, k - len(taken))]
        assert metrics.select_diverse(names, corr, k, limit) == taken


def test_keep_first_and_cap(spark):
    from gridlab.operators.describe import dedup_keep_first
    from gridlab.operators.sampling import hash_order_limit
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 3), (1, "c", 3), (2, None, 9), (None, "d", 1), (None, "e", 0)], "k int, v string, o int")
    assert sorted(map(tuple, dedup_keep_first(df, ["k"], "o").collect()), key=repr) == [(1, "b", 3), (2, None, 9), (None, "e", 0)]
    assert dedup_keep_first(df, ["k"], "o").columns == df.columns
    rows = spark.range(100).withColumnRenamed("id", "a")
    some = hash_order_limit(rows, ["a"], 30, 42)
    assert some.count() == 30 == some.distinct().count() and hash_order_limit(rows, ["a"], 200, 42).count() == 100
    assert sorted(r.a for r in some.collect()) == sorted(r.a for r in hash_order_limit(rows.repartition(7), ["a"], 30, 42).collect())


def test_cell_reduce_single_exchange(spark):
    """All per-cell temporal features (stats + bio windows + aggregate) come
    from one exchange of a materialised cube on the cell key."""
    import datetime as dt
    import re
    from gridlab.config import FeatureParams
    from gridlab.session import cut_lineage
    vars_ = ("tmax", "tmin", "ppt", "pet", "soil", "vpd", "def", "pdsi")
    rows = [(i, j, t, float(i), float(j), dt.date(2020 + t // 12, t % 12 + 1, 1), *[float(t + k) for k in range(8)])
            for i in range(2) for j in range(2) for t in range(14)]
    cols = "lat_idx int, lon_idx int, time_idx int, lat double, lon double, month date, " + \
        ", ".join(f"`{v}` double" for v in vars_)
    cube = cut_lineage(spark.createDataFrame(rows, cols))
    df = temporal.cell_reduce(cube, list(vars_), FeatureParams(variables=vars_), 14)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange ", plan)) == 1
    assert df.count() == 4 and "bio_hot_dry_longest_spell" in df.columns


def test_regular_axes_by_arithmetic(spark):
    """Arithmetic gives the nearest coordinate, the larger one on midpoints,
    the edges outside, and null for null and NaN - as irregular axes do."""
    rng = np.random.default_rng(9)
    axis = [-39.75 + i * 0.25 for i in range(30)]
    bent = [*axis[:-1], axis[-1] + 0.001]
    xs = [*(float(x) for x in rng.uniform(-45, -25, 300)), *((a + b) / 2 for a, b in zip(axis, axis[1:])), *axis, None, float("nan")]
    df = spark.createDataFrame([(i, x, x) for i, x in enumerate(xs)], "i int, Latitude double, Longitude double")
    for r in nearest.nearest_cell_index(df, axis, bent).collect():
        x = xs[r.i]
        if x is None or math.isnan(x):
            assert r.lat_idx is None and r.lon_idx is None
        else:
            for got, values in ((r.lat_idx, axis), (r.lon_idx, bent)):
                mids = [(a + b) / 2 for a, b in zip(values, values[1:])]
                assert got == sum(x >= m for m in mids)
