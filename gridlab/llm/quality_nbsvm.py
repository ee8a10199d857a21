"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams: 3- and 4-grams of characters
(digits alike) and 1- to 3-grams of word shapes. Each indicator is scaled by
the log ratio of its class counts, the row is brought to unit length, and a
linear model with squared-free hinge loss is fitted by dual coordinate
descent, then drawn towards its mean magnitude as the method's authors do.
Margins become probabilities by a logistic fit on a quarter of the sample that
the model did not see, weighted to the classes' true shares.

The fit uses a sample of at most about ``sample`` labelled rows of each class
(documented bound; drawn by a hash of the id, so it does not depend on the
partitioning). The drawn ids are few enough to broadcast, so no text is
shuffled for the fit but the sample's own. Scores cover every whole text.

Defined cases: null and empty texts have no features and get the model's
score of an empty row; rows with null labels are ignored; with one class only,
or none, every score is that class's share (0.5 without labels); documents
that repeat a doc_id each get a row.
Long texts are read whole, one at a time; rows that repeat a document train
once; equal texts get equal scores, and a score at the threshold counts as 1;
only doc_id and text of the documents are read, so no other name can clash.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import letter_grams, row_blocks, shape_grams

DIMS = 1 << 16
SIZES = (3, 4)
SAMPLE = 4000
EPOCHS = 12
COST = 1.0
SMOOTHING = 1.0
INTERPOLATION = 0.75
THRESHOLD = 0.3

_DIGITS_ALIKE = np.arange(256, dtype=np.uint8)
_DIGITS_ALIKE[48:58] = 48


def _indicators(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, boolean features of the rows) in dense blocks; character
    grams fill the first half, shapes the second."""
    for first, data, off in row_blocks(texts):
        out = np.zeros((len(off) - 1, DIMS), bool)
        for text, bucket in letter_grams(_DIGITS_ALIKE[data], off, SIZES, DIMS // 2):
            out[text, bucket] = True
        text, bucket = shape_grams(data, off, DIMS // 2)
        out[text, DIMS // 2 + bucket] = True
        yield first, out


def log_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = [np.full(DIMS, SMOOTHING), np.full(DIMS, SMOOTHING)]
    for own, label in zip(rows, y):
        counts[int(label)][own] += 1
    return np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum())).astype(np.float32)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int) -> tuple[np.ndarray, float]:
    """Hinge-loss weights and bias: one dual variable a row, kept in [0, cost],
    changed one at a time in a fixed random order."""
    w, bias = np.zeros(DIMS), 0.0
    alpha = np.zeros(len(rows))
    sign = np.where(y > 0, 1.0, -1.0)
    square = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.RandomState(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


def logistic_fit(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps; labels are drawn
    in a little, so that a perfect separation has a finite fit."""
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(weight * (p - target) * margin).sum() + 1e-3 * a, (weight * (p - target)).sum() + 1e-3 * b])
        s = weight * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit_rows(texts: pa.Array, y: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(weights of unit indicators, log ratios, bias, slope, offset)."""
    rows: list[np.ndarray] = []
    for _, block in _indicators(texts):
        rows.extend(np.flatnonzero(r) for r in block)
    check = np.random.RandomState(11).permutation(len(y)) % 4 == 0
    if len(set(y[~check])) < 2:
        check[:] = False
    ratio = log_ratios([r for r, c in zip(rows, check) if not c], y[~check])
    values = [ratio[r] / max(1e-9, float(np.linalg.norm(ratio[r]))) for r in rows]
    cost = np.where(y > 0, COST * len(y) / (2 * max(1, (y > 0).sum())), COST * len(y) / (2 * max(1, (y == 0).sum())))
    train = np.flatnonzero(~check)
    w, bias = dual_descent([rows[i] for i in train], [values[i] for i in train], y[train], cost[train], EPOCHS)
    w = INTERPOLATION * w + (1 - INTERPOLATION) * np.abs(w).mean() * np.sign(w)
    seen = np.flatnonzero(check) if check.any() else np.arange(len(y))
    margin = np.array([w[rows[i]] @ values[i] + bias for i in seen])
    own = y[seen]
    weight = np.where(own > 0, share / max(1e-9, own.mean()), (1 - share) / max(1e-9, 1 - own.mean()))
    slope, offset = logistic_fit(margin, own, weight)
    return w, ratio, bias, slope, offset


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The model from documents (doc_id, text) and labels (doc_id, quality).
    It is fitted in one task, from a bounded sample."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y"))
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.5
    if len(sizes) < 2:
        return share
    rate = F.when(F.col("y") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    drawn = marked.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < rate * 1_000_000) \
        .groupBy("doc_id").agg(F.min("y").alias("y"))  # at most about 2 x sample ids
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id") \
        .dropDuplicates(["doc_id", "text"])  # a document that is repeated a million times is one training row

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        y = table.column("y").to_numpy().astype(np.float64)
        if len(set(y)) < 2:
            w, ratio, bias, slope, offset = np.zeros(DIMS), np.zeros(DIMS), 0.0, 1.0, 0.0
        else:
            w, ratio, bias, slope, offset = fit_rows(table.column("text"), y, share)
        return pa.table({"w": pa.array([w.tolist()], pa.list_(pa.float64())), "ratio": pa.array([ratio.tolist()], pa.list_(pa.float64())),
                         "bias": [float(bias)], "slope": [slope], "offset": [offset]})

    got = rows.groupBy(F.lit(0).alias("one")).applyInArrow(
        lambda key, table: run(table), "w array<double>, ratio array<double>, bias double, slope double, offset double").collect()
    if not got:
        return share
    m = got[0]
    return (np.array(m["w"], np.float32), np.array(m["ratio"], np.float32), m["bias"], m["slope"], m["offset"])


def scorer(spark, model):
    """A column function of text: the probability of label 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in parts:
            if isinstance(model, float):
                yield pa.array(np.full(len(texts), model))
                continue
            w, ratio, bias, slope, offset = model
            both = np.stack([w * ratio, ratio * ratio], axis=1).astype(np.float32)
            out = np.zeros(len(texts))
            for first, block in _indicators(texts):
                sums = block.astype(np.float32) @ both
                out[first:first + len(block)] = sums[:, 0] / np.sqrt(np.maximum(sums[:, 1], 1e-9)) + bias
            yield pa.array(1 / (1 + np.exp(-np.clip(slope * out + offset, -30, 30))))
    return score


def quality_scores(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score and predicted of every document."""
    score = scorer(documents.sparkSession, fit(documents, labels, sample))
    return documents.select("doc_id", score("text").alias("score")).select(
        "doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
