"""Language ID by nearest centroid of TF-IDF n-gram vectors.

A text is the unit vector of its hashed letter 2- to 4-grams, weighted by
log(1 + count) times inverse document frequency. Document frequencies are
counted over all training texts. Each language has ``centroids`` centres from
spherical k-means on a sample of at most about ``sample`` training texts per
language (drawn by a hash of the text and id, so it does not depend on the
partitioning). A text gets the language of the centre with the largest cosine,
and is rejected if that cosine is below the language's floor: ``FLOOR_SHARE`` of
the ``FLOOR_QUANTILE`` quantile of the cosines that all training texts of the
language have to its centres, found in one distributed pass. So a text is
rejected if it is far beyond what all but a few training texts show, and single
odd texts do not move the floor. Equal cosines: the first language by name.

What is broadcast is languages x centroids x ``DIMS`` floats; more than
``MAX_LANGUAGES`` languages are an error, not a larger broadcast.

Defined cases: null texts and texts without a letter (Unicode category L; not
numbers written with letters) are `und`, score 0, and rejected; without
training texts everything is; equal texts get equal results; long texts are
read whole, one at a time; other columns than doc_id, text and lang are not read.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import LETTERS, letter_grams, row_blocks
from .textops import give_back

DIMS = 1 << 14
SIZES = (2, 3, 4)
CENTROIDS = 4
SAMPLE = 1000
ITERATIONS = 8
MAX_LANGUAGES = 300
UNKNOWN = "und"
FLOOR_QUANTILE = 0.01
FLOOR_SHARE = 0.5
_STEPS = 4096  # of the histogram of cosines
_LETTER = regex.compile(r"\p{L}")  # the same letters as in Spark's patterns


def _counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, n-gram counts of the rows) in dense blocks."""
    lower = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    for first, data, off in row_blocks(lower):
        data, rows = LETTERS[data], len(off) - 1
        out = np.zeros(rows * DIMS, np.int64)
        for text, bucket in letter_grams(data, off, SIZES, DIMS):
            out += np.bincount(text * DIMS + bucket, minlength=rows * DIMS)
        yield first, out.reshape(rows, DIMS)


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts, dtype=np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Inverse document frequency of each bucket over all ``texts`` (text).
    Every task sums its own texts; ``DIMS`` sums come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for _, counts in _counts(batch.column("text")):
                seen += (counts > 0).sum(axis=0)
                n += len(counts)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], ["bucket", "n"])

    sums = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = dict((r["bucket"], r["n"]) for r in sums)
    found = np.array([seen.get(b, 0) for b in range(DIMS)], np.float64)
    return (np.log((1 + seen.get(-1, 0)) / (1 + found)) + 1).astype(np.float32)


def _kmeans(x: np.ndarray, k: int, iterations: int) -> np.ndarray:
    """Centres; the first is the mean, each further one the text that is least
    like those before."""
    k = min(k, len(x))
    centres = [x.mean(axis=0)]
    near = x @ centres[0]
    for _ in range(1, k):
        centres.append(x[int(np.argmin(near))])
        near = np.maximum(near, x @ centres[-1])
    c = np.array(centres)
    for _ in range(iterations):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(k)])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _floors(rows: DataFrame, shared) -> dict[str, float]:
    """The floor of each language from all its training texts: every task
    counts its cosines in ``_STEPS`` steps, so languages x steps rows at most
    come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, langs, centres = shared.value
        own = {lang: np.flatnonzero(np.array(langs, object) == lang) for lang in set(langs)}
        seen: Counter = Counter()
        for batch in batches:
            lang = batch.column("lang").to_pylist()
            for first, counts in _counts(batch.column("text")):
                cosines = _unit(counts, idf) @ centres.T
                for i in range(len(counts)):
                    at = own.get(lang[first + i])
                    if at is not None:
                        seen[lang[first + i], int(max(0.0, float(cosines[i, at].max())) * _STEPS)] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                                          pa.array([seen[k] for k in keys], pa.int64())], ["lang", "step", "n"])
        give_back()

    found: dict[str, list] = {}
    for r in rows.select("text", "lang").mapInArrow(run, "lang string, step int, n long").groupBy("lang", "step").agg(F.sum("n").alias("n")) \
            .orderBy("lang", "step").collect():
        found.setdefault(r["lang"], []).append((r["step"], r["n"]))
    out = {}
    for lang, steps in found.items():
        below = np.cumsum([n for _, n in steps])
        out[lang] = FLOOR_SHARE * steps[int(np.searchsorted(below, FLOOR_QUANTILE * below[-1], "right"))][0] / _STEPS
    return out


def fit(training: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE, iterations: int = ITERATIONS):
    """The model (idf, languages of the centres, centres, floors) from
    (doc_id, text, lang); rows with null lang or no letter are ignored."""
    rows = training.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    idf = inverse_frequencies(rows)
    spark = training.sparkSession
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).take(MAX_LANGUAGES + 1)}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; what is broadcast would grow with the data")
    if not sizes:
        return idf, [], np.zeros((0, DIMS), np.float32), np.zeros(0)
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share * 1_000_000)
    weights = spark.sparkContext.broadcast(idf)

    def centres(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "text"])
        x = np.concatenate([_unit(c, weights.value) for _, c in _counts(pa.array(frame["text"], pa.large_string()))])
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "centre": list(_kmeans(x, centroids, iterations).astype(np.float32))})

    found = drawn.groupBy("lang").applyInPandas(centres, "lang string, centre array<float>").collect()
    found.sort(key=lambda r: (r["lang"], r["centre"]))
    langs, table = [r["lang"] for r in found], np.array([r["centre"] for r in found], np.float32).reshape(-1, DIMS)
    floors = _floors(rows, spark.sparkContext.broadcast((idf, langs, table)))
    return idf, langs, table, np.array([floors.get(lang, 0.0) for lang in langs])


def predictor(spark, model):
    """A column function of text: struct(lang_pred, score, rejected)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred string, score double, rejected boolean>")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        idf, langs, centres, floors = shared.value
        for texts in parts:
            lang = np.full(len(texts), UNKNOWN, object)
            score, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
            for first, counts in _counts(texts) if len(langs) else ():
                cosines = _unit(counts, idf) @ centres.T
                best = np.argmax(cosines, axis=1)
                for i, j in enumerate(best):
                    text = texts[first + i].as_py()
                    if text and _LETTER.search(text):
                        lang[first + i] = langs[j]
                        score[first + i] = min(1.0, max(0.0, float(cosines[i, j])))
                        rejected[first + i] = cosines[i, j] < floors[j]
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                                             ["lang_pred", "score", "rejected"])
    return predict
