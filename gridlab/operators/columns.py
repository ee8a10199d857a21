"""Exact statistics of each feature in each of many overlapping sets of rows.

Rows hold their values as one array and the sets that use them (one entry a
copy). Tasks read them as NumPy blocks and keep one small table of (set,
feature) counts and sums, so neither rows nor values are copied for each set
and no more than these tables is exchanged, however many values are distinct.

Medians are found by narrowing: a bracket around each median (guessed from a
few thousand rows, then counted over all) is cut into buckets, and the bucket
with the middle ranks is the next bracket, until few values are left. These are
sorted. A guess that misses costs another round, never a wrong median.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64
LEFT = 4_000_000  # values, over all sets and features, that are sorted at the end
GUESS = 4096  # rows that the first brackets are guessed from
BLOCK = 1_000_000  # values that a task holds at a time
ROUNDS = 12
_MOST = 8e307


def _blocks(batches, n: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(values, copies): rows x width with NaN for nulls, and rows x n."""
    step = max(1, BLOCK // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            f, uses = part.column("f"), part.column("uses")
            x = f.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, width) + 0.0  # no -0.0
            sizes = np.diff(uses.offsets.to_numpy())
            at_row = np.repeat(np.arange(part.num_rows), sizes)
            c = np.bincount(at_row * n + uses.flatten().to_numpy(zero_copy_only=False), minlength=part.num_rows * n)
            yield x, c.reshape(part.num_rows, n)


def _of_sets(x: np.ndarray, c: np.ndarray):
    """(set, its rows' values, their copies)."""
    for s in range(c.shape[1]):
        own = np.flatnonzero(c[:, s])
        if len(own):
            yield s, (x if len(own) == len(x) else x[own]), c[own, s]


def _merged(rows: DataFrame, task, schema: str, merge) -> dict[int, list[np.ndarray]]:
    """What the tasks found for each set, merged in Spark: set -> arrays."""
    names = [c.split()[0] for c in schema.split(", ")]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        out = merge([np.stack(frame[c].to_numpy()).astype(np.float64) for c in names[1:]])
        return pd.DataFrame({names[0]: frame[names[0]].iloc[:1].to_numpy(), **{c: [v] for c, v in zip(names[1:], out)}})

    found = rows.mapInArrow(task, schema).groupBy(names[0]).applyInPandas(one, schema).collect()
    return {r[names[0]]: [np.array(r[c], np.float64) for c in names[1:]] for r in found}  # NaN come back as nulls


def _batch(names: list[str], rows: list[tuple], kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _sums(rows: DataFrame, n: int, width: int) -> dict[int, list[np.ndarray]]:
    """set -> copies, and of each feature: values, least, largest, sum, sum of squares."""
    def task(batches):
        total = np.zeros((n, width))
        held, lo, hi, s1, s2 = total.copy(), total + np.inf, total - np.inf, total.copy(), total.copy()
        for x, c in _blocks(batches, n, width):
            gap, k = np.isnan(x), c.T.astype(np.float64)
            total += k.sum(1)[:, None]
            held += k @ ~gap
            for s, v, _ in _of_sets(np.where(gap, np.inf, x), c):
                np.minimum(lo[s], v.min(0), out=lo[s])
            x = np.where(gap, -np.inf, x)
            for s, v, _ in _of_sets(x, c):
                np.maximum(hi[s], v.max(0), out=hi[s])
            x[gap] = 0.0
            if np.abs(x).max(initial=0.0) < 1e150:
                s1 += k @ x
                s2 += k @ (x * x)
            else:  # no 0 * inf in a product
                for s, v, own in _of_sets(x, c):
                    s1[s] += (v * own[:, None]).sum(0)
                    with np.errstate(over="ignore", invalid="ignore"):
                        s2[s] += (v * v * own[:, None]).sum(0)
        out = [(s, total[s], held[s], lo[s], hi[s], s1[s], s2[s]) for s in range(n) if total[s].any()]
        yield _batch(["set", "n", "held", "lo", "hi", "s", "ss"], out, [pa.int32()] + [pa.list_(pa.float64())] * 6)

    def merge(v):
        return [v[0].sum(0), v[1].sum(0), v[2].min(0), v[3].max(0), v[4].sum(0), v[5].sum(0)]

    return _merged(rows, task, "set int, n array<double>, held array<double>, lo array<double>, hi array<double>, s array<double>, ss array<double>", merge)


def _bucket(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 below [a, b], 1 .. BUCKETS inside, BUCKETS + 1 above; never falling as v rises."""
    v = np.clip(v, -_MOST, _MOST)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        scale = np.where(b > a, BUCKETS / (b - a), 0.0)
        k = np.clip(np.floor((v - a) * scale), 0, BUCKETS - 1) + 1
    return np.where(v < a, 0, np.where(v > b, BUCKETS + 1, k)).astype(np.int64)


def _inside(v: np.ndarray, s: int, levels):
    """(row, feature, value) of the values that lie in the buckets chosen so far."""
    if not levels:
        r, j = np.nonzero(~np.isnan(v))
        return r, j, v[r, j]
    least, most = levels[-1][4:]
    r, j = np.nonzero((v >= least[s]) & (v <= most[s]))  # a few more, or equal
    x = v[r, j]
    for a, b, first, last, *_ in levels:
        k = _bucket(x, a[s][j], b[s][j])
        keep = (k >= first[s][j]) & (k <= last[s][j])
        r, j, x = r[keep], j[keep], x[keep]
    return r, j, x


def _histogram(rows: DataFrame, n: int, width: int, levels, a, b) -> np.ndarray:
    """(set, feature, bucket): copies of the values in the chosen buckets; what
    lies above the bracket is left out."""
    def task(batches):
        out = np.zeros((n, width, BUCKETS + 2))
        for x, c in _blocks(batches, n, width):
            for s, v, k in _of_sets(x, c):
                if levels:
                    r, j, y = _inside(v, s, levels)
                else:
                    low = v < a[s]
                    out[s, :, 0] += k @ low
                    r, j = np.nonzero((v <= b[s]) & ~low)
                    y = v[r, j]
                to = j * (BUCKETS + 2) + _bucket(y, a[s][j], b[s][j])
                out[s] += np.bincount(to, k[r], width * (BUCKETS + 2)).reshape(width, -1)
        yield _batch(["set", "h"], [(s, out[s].ravel()) for s in range(n)], [pa.int32(), pa.list_(pa.float64())])

    found = _merged(rows, task, "set int, h array<double>", lambda v: [v[0].sum(0)])
    return np.stack([found[s][0] if s in found else np.zeros(width * (BUCKETS + 2)) for s in range(n)]).reshape(n, width, BUCKETS + 2)


def _guessed(rows: DataFrame, n: int, width: int, many: int, lo, hi):
    """Brackets that hold the medians, by all likelihood, from the rows that a hash picks."""
    one_in = max(1, many // GUESS)
    some = rows.where(F.pmod(F.xxhash64("row_id"), F.lit(one_in)) == 0).select("f", "uses").toArrow()
    a, b = lo.copy(), hi.copy()
    parts = [*_blocks(some.combine_chunks().to_batches(), n, width)]
    for s in range(n):
        v = np.concatenate([np.repeat(x, c[:, s], axis=0) for x, c in parts]) if parts else np.zeros((0, width))
        if len(v) < 100:
            continue
        v.sort(axis=0)  # NaN last
        m = len(v) - np.isnan(v).sum(0)
        off = 1.5 * np.sqrt(np.maximum(m, 1)) + 1
        low, high, at = np.floor(m / 2 - off).astype(int), np.ceil(m / 2 + off).astype(int), np.arange(width)
        a[s] = np.where((low >= 0) & (m > 0), v[np.clip(low, 0, len(v) - 1), at], lo[s])
        b[s] = np.where(high < m, v[np.clip(high, 0, len(v) - 1), at], hi[s])
    return a, b


def _medians(rows: DataFrame, n: int, width: int, many: int, held, lo, hi) -> np.ndarray:
    """(set, feature): the exact median of the values, NaN without any."""
    place = 0.5 * (held - 1)
    low, high = np.floor(place), np.ceil(place)
    lo, hi = np.clip(lo, -_MOST, _MOST), np.clip(hi, -_MOST, _MOST)
    below, levels, left = np.zeros((n, width)), [], held.sum()
    least, most = np.full((n, width), -np.inf), np.full((n, width), np.inf)
    while left > LEFT and len(levels) < ROUNDS:
        a, b = (lo, hi) if levels else _guessed(rows, n, width, many, lo, hi)
        h = _histogram(rows, n, width, levels, a, b)
        upto = below[:, :, None] + h.cumsum(2)
        first, last = ((upto <= r[:, :, None]).sum(2).clip(0, BUCKETS + 1) for r in (low, high))
        cut = np.concatenate([below[:, :, None], upto], axis=2)
        below = np.take_along_axis(cut, first[:, :, None], 2)[:, :, 0]
        step = np.maximum(b - a, 0) / BUCKETS
        # the next bracket; what rounding puts outside is counted at its rim
        lo, hi = (np.where(first == 0, lo, a + (first - 1) * step), np.where(last == BUCKETS + 1, hi, a + last * step))
        slack = step / 8 + 1e-12 * np.maximum(np.abs(a), np.abs(b))
        least = np.where(first == 0, least, np.maximum(least, a + (first - 1) * step - slack))
        most = np.where(last == BUCKETS + 1, most, np.minimum(most, a + last * step + slack))
        levels.append((a, b, first, last, least, most))
        within = np.take_along_axis(cut, np.minimum(last, BUCKETS)[:, :, None] + 1, 2)[:, :, 0] - below
        rest = np.where(last == BUCKETS + 1, held - below, within).sum()
        if rest > left / 2 and len(levels) > 1:  # many equal values
            break
        left = rest

    def task(batches):
        for x, c in _blocks(batches, n, width):
            for s, v, k in _of_sets(x, c):
                r, j, y = _inside(v, s, levels)
                if not len(r):
                    continue
                order = np.lexsort((y, j))
                j, y = j[order], y[order]
                start = np.flatnonzero(np.concatenate([[True], (j[1:] != j[:-1]) | (y[1:] != y[:-1])]))
                times = np.add.reduceat(k[r][order].astype(np.float64), start)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(times), s, np.int32)), pa.array(j[start].astype(np.int32)), pa.array(y[start]),
                                                  pa.array(times)], ["set", "pos", "v", "k"])

    counts = rows.mapInArrow(task, "set int, pos int, v double, k double").groupBy("set", "pos", "v").agg(F.sum("k").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("set", "pos").orderBy("v"))
    bounds = rows.sparkSession.createDataFrame([(s, j, float(below[s, j]), float(low[s, j]), float(high[s, j])) for s in range(n) for j in range(width)],
                                               "set int, pos int, below double, low double, high double")
    ranked = counts.withColumn("upto", upto).join(F.broadcast(bounds), ["set", "pos"]).withColumn("upto", F.col("below") + F.col("upto"))

    def at(rank: str):
        return F.max(F.when((F.col("upto") - F.col("k") <= F.col(rank)) & (F.col(rank) < F.col("upto")), F.col("v")))

    out = np.full((n, width), np.nan)
    for r in ranked.groupBy("set", "pos").agg(at("low").alias("low"), at("high").alias("high")).collect():
        if r["low"] is not None and r["high"] is not None:
            q = place[r["set"], r["pos"]]
            out[r["set"], r["pos"]] = r["low"] + (r["high"] - r["low"]) * (q - np.floor(q))
    return out


def set_statistics(members: DataFrame, n: int, many: int, width: int) -> dict[int, tuple[np.ndarray, ...]]:
    """set -> (known, median, lo, hi, mean, sd) of its features; known: which
    have a value; mean and deviation are those of the rows filled with the
    median. members (written): row_id, f (``width`` values, nulls where there
    is none), uses (of the sets 0 .. n - 1); many: about how many rows."""
    rows = members.select("row_id", "f", "uses")
    rows = rows.coalesce(max(1, 4 * members.sparkSession.sparkContext.defaultParallelism))  # tasks return whole tables
    sums = _sums(rows, n, width)
    if not sums:
        return {}
    zero = [np.zeros(width)] * 6
    total, held, lo, hi, s1, s2 = (np.stack([sums.get(s, zero)[i] for s in range(n)]) for i in range(6))
    m = _medians(rows, n, width, many, held, lo, hi)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        nulls = total - held
        mean = (s1 + np.where(nulls > 0, nulls * m, 0.0)) / total
        square = (s2 + np.where(nulls > 0, nulls * m * m, 0.0)) / total
        sd = np.sqrt(np.maximum(square - mean * mean, 0.0))
    return {s: (held[s] > 0, m[s], lo[s], hi[s], mean[s], sd[s]) for s in sums}
