"""Scoring and selection over a long predictions table.

``preds``: one row per (candidate, row) with ``y`` (0/1) and ``p``.

E1 as a histogram: each row's bucket is the number of grid thresholds
<= p (a short CASE tree, codegen'd). One aggregate per (candidate, bucket)
with map-side combine; the at most len(grid)+1 buckets of a candidate then
give tp/fp for every threshold at once.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bucket_index, f1_from_counts


def _grid_value(grid: Sequence[float], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(t)) for t in grid]), (i + 1).cast("int"))


def threshold_sweep(preds: DataFrame, grid: Sequence[float], keys=("candidate",)) -> DataFrame:
    """keys, i, threshold, tp, fp, fn, f1 for every threshold of ``grid``."""
    keys = list(keys)
    T = len(grid)
    counts = (preds.select(*keys, bucket_index(F.col("p"), grid).alias("bucket"), "y")
              .groupBy(*keys, "bucket")
              .agg(F.sum(F.col("y")).cast("long").alias("pos"),
                   F.sum(F.lit(1) - F.col("y")).cast("long").alias("neg")))
    hist = counts.groupBy(*keys).agg(F.collect_list(F.struct("bucket", "pos", "neg")).alias("h")) \
        .select(*keys, "h", F.explode(F.sequence(F.lit(1), F.lit(T))).alias("b"))

    def total(field: str, least: Column) -> Column:
        return F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + F.when(x["bucket"] >= least, x[field]).otherwise(F.lit(0).cast("long")))

    out = hist.select(*keys, (F.col("b") - 1).cast("int").alias("i"), _grid_value(grid, F.col("b") - 1).alias("threshold"),
                      total("pos", F.col("b")).alias("tp"), total("neg", F.col("b")).alias("fp"), total("pos", F.lit(0)).alias("p")) \
        .select(*keys, "i", "threshold", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"))
    return out.withColumn("f1", f1_from_counts("tp", "fp", "fn"))


def best_threshold(sweep: DataFrame, keys=("candidate",)) -> DataFrame:
    """First maximum of F1 over the grid (lower threshold on ties)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col("f1").desc(), F.col("i").asc())
    return (sweep.withColumn("__r", F.row_number().over(w)).where("__r = 1")
            .select(*keys, "threshold", F.col("f1").alias("oof_f1")))


def candidate_eval(preds: DataFrame, grid: Sequence[float], focus: Sequence[float],
                   keys=("candidate",)) -> DataFrame:
    """Best on the full grid; best / mean / min on the focus grid."""
    keys = list(keys)
    sw = threshold_sweep(preds, grid, keys)
    fset = set(float(t) for t in focus)
    focus_pos = [i for i, t in enumerate(grid) if float(t) in fset]
    sw = sw.withColumn("in_focus", F.col("i").isin(focus_pos))
    best = best_threshold(sw, keys).withColumnRenamed("threshold", "best_threshold") \
        .withColumnRenamed("oof_f1", "best_oof_f1")
    fb = best_threshold(sw.where("in_focus"), keys).withColumnRenamed("threshold", "focus_best_threshold") \
        .withColumnRenamed("oof_f1", "focus_best_oof_f1")
    fa = sw.where("in_focus").groupBy(*keys).agg(F.avg("f1").alias("focus_mean_oof_f1"),
                                                 F.min("f1").alias("focus_min_oof_f1"))
    return best.join(fb, keys).join(fa, keys)


def rank_candidates(ev: DataFrame, order_key: str = "build_order") -> DataFrame:
    """T4: lexicographic (focus best, focus mean, best) ranking, build order on ties."""
    w = Window.orderBy(F.col("focus_best_oof_f1").desc(), F.col("focus_mean_oof_f1").desc(),
                       F.col("best_oof_f1").desc(), F.col(order_key).asc())
    # candidates table: one row per candidate (bounded by the candidate count)
    return ev.withColumn("rank", F.row_number().over(w))


def recommendations(ev: DataFrame, grid: Sequence[float], within: float = 0.04) -> DataFrame:
    """Grid thresholds within 0.04 (+1e-9) of each candidate's focus best."""
    g = F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("threshold")
    return (ev.select("candidate", "focus_best_threshold", g)
            .where(F.abs(F.col("threshold") - F.col("focus_best_threshold")) <= F.lit(within + 1e-9))
            .select("candidate", "threshold"))


def confusion(preds: DataFrame, threshold_col: Column, keys=("candidate",)) -> DataFrame:
    """Counts per (true, predicted) class, predicted = p >= threshold."""
    pred = (F.col("p") >= threshold_col).cast("int")
    return (preds.select(*keys, F.col("y").alias("actual"), pred.alias("predicted"))
            .groupBy(*keys, "actual", "predicted").agg(F.count(F.lit(1)).alias("n")))


def class_report(preds: DataFrame, threshold_col: Column, keys=("candidate",)) -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and
    weighted averages, from one aggregate of the confusion counts."""
    keys = list(keys)
    pred = (F.col("p") >= threshold_col).cast("int")
    y = F.col("y")
    c = preds.select(*keys, y.alias("y"), pred.alias("yh")).groupBy(*keys).agg(
        F.sum(F.when((F.col("y") == 1) & (F.col("yh") == 1), 1).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("y") == 0) & (F.col("yh") == 1), 1).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("y") == 1) & (F.col("yh") == 0), 1).otherwise(0)).alias("fn"),
        F.sum(F.when((F.col("y") == 0) & (F.col("yh") == 0), 1).otherwise(0)).alias("tn"))

    def prf(tp, fp, fn):
        prec = F.when((tp + fp) > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
        rec = F.when((tp + fn) > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
        f1 = F.when((prec + rec) > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
        return prec, rec, f1

    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    n = s1 + s0
    rows = F.array(
        F.struct(F.lit("0").alias("label"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1"), s0.alias("support")),
        F.struct(F.lit("1").alias("label"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1"), s1.alias("support")),
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), ((tp + tn) / n).alias("f1"), n.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
                 ((f0 + f1) / 2).alias("f1"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), ((p0 * s0 + p1 * s1) / n).alias("precision"),
                 ((r0 * s0 + r1 * s1) / n).alias("recall"), ((f0 * s0 + f1 * s1) / n).alias("f1"),
                 n.alias("support")))
    return c.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def wide_predictions(preds: DataFrame, names: Sequence[str], index=("row_id",)) -> DataFrame:
    """One column per candidate, aligned on the row key (pivot with an
    explicit value list, so no distinct pass)."""
    return preds.groupBy(*index).pivot("candidate", list(names)).agg(F.first("p"))


class Moments(NamedTuple):
    """Of k columns: rows, lowest, highest and mean values, and the k x k sums
    of products of deviations from the means."""
    n: int
    lo: np.ndarray
    hi: np.ndarray
    mean: np.ndarray
    products: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        return Moments(len(x), x.min(axis=0), x.max(axis=0), mean, (x - mean).T @ (x - mean))

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(n, np.minimum(self.lo, other.lo), np.maximum(self.hi, other.hi), self.mean + gap * (other.n / n),
                       self.products + other.products + np.outer(gap, gap) * (self.n * other.n / n))

    def row(self) -> pa.Table:
        return pa.table({"n": [self.n], **{c: [np.asarray(v).ravel().tolist()] for c, v in zip(_MOMENTS, self[1:])}})


_MOMENTS = ("lo", "hi", "mean", "products")
_MERGES = 32


def column_moments(wide: DataFrame, columns: Sequence[str]) -> Moments | None:
    """The moments of ``columns`` over all rows: one accumulator a task, merged
    in ``_MERGES`` groups, of which that many rows reach the driver. A missing
    value counts as NaN."""
    schema = "n long, " + ", ".join(f"{c} array<double>" for c in _MOMENTS)
    k = len(columns)

    def read(table: pa.Table) -> Iterator[Moments]:
        for r in table.to_pylist():
            yield Moments(r["n"], *(np.array(r[c]) for c in _MOMENTS[:3]), np.array(r["products"]).reshape(k, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            if b.num_rows:
                part = Moments.of(np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns]))
                own = part if own is None else own.merged(part)
        if own is not None:
            yield from own.row().to_batches()

    def merge(table: pa.Table) -> pa.Table:
        return reduce(Moments.merged, read(table)).row()

    parts = wide.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, schema)  # names may contain dots
    merged = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(_MERGES)).alias("g")).applyInArrow(merge, schema).toArrow()
    return reduce(Moments.merged, read(merged)) if merged.num_rows else None


def correlations(wide: DataFrame, names: Sequence[str], rtol: float = 1e-5, atol: float = 1e-8) -> dict[tuple[str, str], float]:
    """Pearson correlation of every pair of columns. A constant column
    (max - min within atol + rtol * |min|) or a non-finite value gives 1.0, as
    in the reference."""
    m = column_moments(wide, names) if len(names) > 1 else None
    out = {(a, b): 1.0 for i, a in enumerate(names) for b in names[i + 1:]}
    if m is None:
        return out
    with np.errstate(invalid="ignore"):
        usable = np.isfinite(m.lo) & np.isfinite(m.hi) & (m.hi - m.lo > atol + rtol * np.abs(m.lo))
        spread = np.sqrt(np.diag(m.products))
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            if usable[i] and usable[j] and spread[i] * spread[j] > 0:
                out[a, names[j]] = float(m.products[i, j] / (spread[i] * spread[j]))
    return out


def candidate_corr(preds: DataFrame, names: Sequence[str]) -> DataFrame:
    """A24 as a table: cand_a, cand_b, corr."""
    found = correlations(wide_predictions(preds, names), names)
    return preds.sparkSession.createDataFrame([(a, b, r) for (a, b), r in found.items()], "cand_a string, cand_b string, corr double")


def select_diverse(ranked: Sequence[str], corr: dict[tuple[str, str], float], top_k: int,
                   max_corr: float) -> list[str]:
    """T5: the ``top_k`` candidates that come first when those too alike to a
    better one are moved behind all others. Works on the k x k correlation
    matrix in rank order (bounded by the candidate count); a pair without a
    correlation counts as alike."""
    n = len(ranked)
    alike = np.ones((n, n), bool)
    place = {name: i for i, name in enumerate(ranked)}
    for (a, b), r in corr.items():
        if a in place and b in place:
            alike[place[a], place[b]] = alike[place[b], place[a]] = not abs(r) < max_corr
    behind = np.zeros(n, bool)
    for i in range(n):
        behind[i] = (alike[i, :i] & ~behind[:i]).any()
    return [ranked[i] for i in np.argsort(behind, kind="stable")[:top_k]]
