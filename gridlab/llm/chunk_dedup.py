"""Substring dedup by content-defined chunks.

A gear hash rolls over the text's lower-cased bytes: h = (h << 1) + G[byte] in
32 bits, so it depends on the last 32 bytes only. A chunk ends behind a byte
whose hash has ``MASK_BITS`` top bits zero, at the earliest ``MIN_CHUNK`` bytes
after the last end. If none comes in ``MAX_CHUNK`` bytes, as in periodic text,
it ends at the smallest hash among them, which is a mark of the content too.
Equal passages therefore fall into equal chunks but for their rims, wherever
they stand, and an insertion moves no boundary but those next to it.

Chunks are compared by 96-bit digests. A chunk that an earlier document holds
(or the same document, earlier) is a copy; a run of neighbouring copies with
at least ``MIN_RUN_WORDS`` words or ``MIN_RUN_CHARS`` characters, whichever is
met first, is removed (scripts without blanks have few words); a shorter run
stays, since common phrases repeat by chance. The first holder, the smallest doc_id, keeps its text.

Scale: chunks are summed by digest with map-side combine, which leaves the
digests with several places and their first place; the chunks are then joined
with that table, a plain shuffled join that adaptive execution splits where a
chunk is hot. Nothing is collected by chunk, only by document, and no text is
shuffled to find the passages; ``kept_texts`` shuffles each text once to cut
them out. Chunking is repeated for the join instead of
writing all chunks, which would cost more disk than the input.

Defined cases: null and empty texts have no chunks; rows that repeat a doc_id
are one document to the rule, told apart by their text; equal rows of one
doc_id do not make each other copies; rows without a doc_id come last.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, id_or_null, row_id, run_folder, written
from .textops import LOWER, WHITE, text_blocks, word_spans

MASK_BITS = 4
MIN_CHUNK = 16
MAX_CHUNK = 256
MIN_RUN_WORDS = 20
MIN_RUN_CHARS = 200

_GEAR = np.random.RandomState(5489).randint(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash behind each byte: the sum of G[b] << age over the last
    32 bytes, built by doubling the window five times."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            older = h[:-k] << np.uint32(k)
            h = h.copy()
            h[k:] += older
    return h


def chunk_ends(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends of all chunks, number of each text's chunks). Each text is cut as
    if it stood alone: a boundary's window lies in the text."""
    ends: list[int] = []
    counts = np.zeros(len(off) - 1, np.int64)
    hashes = gear_hashes(data)
    cuts = np.flatnonzero(hashes >> np.uint32(32 - MASK_BITS) == 0) + 1
    inner = cuts < len(data)
    cuts = cuts[inner]
    cuts = cuts[(data[cuts] & 0xC0) != 0x80]  # between characters
    which = np.searchsorted(cuts, off)
    cut_list = cuts.tolist()
    for i in range(len(off) - 1):
        at, stop, before = int(off[i]), int(off[i + 1]), len(ends)
        begin = at
        for c in cut_list[which[i]:which[i + 1]]:
            if c - begin < 32 or c - at < MIN_CHUNK or c >= stop:  # the window must lie in the text
                continue
            while c - at > MAX_CHUNK:
                at = _smallest(hashes, data, at)
                ends.append(at)
            if c - at >= MIN_CHUNK:
                ends.append(c)
                at = c
        while stop - at > MAX_CHUNK:
            at = _smallest(hashes, data, at)
            ends.append(at)
        if stop > at:
            ends.append(stop)
        counts[i] = len(ends) - before
    return np.array(ends, np.int64), counts


def _smallest(hashes: np.ndarray, data: np.ndarray, at: int) -> int:
    """The end behind the smallest hash, between characters."""
    ends = np.arange(at + MIN_CHUNK, at + MAX_CHUNK + 1)
    ends = ends[(data[ends] & 0xC0) != 0x80]
    return int(ends[np.argmin(hashes[ends - 1])])


def chunk_rows(rows: DataFrame) -> DataFrame:
    """(id, version, pos, start, size, n_words, h, g) of every chunk of (id,
    version, text): start and size in characters, n_words that begin in the
    chunk, the digest's parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = (batch.column(c).to_numpy() for c in ("id", "version"))
            for first, raw, off in text_blocks(batch.column("text"), 1 << 20):
                data = LOWER[raw]
                ends, counts = chunk_ends(data, off)
                if not len(ends):
                    continue
                text = np.repeat(np.arange(len(counts)), counts)
                heads = np.cumsum(counts) - counts
                starts = np.empty_like(ends)
                starts[1:] = ends[:-1]
                starts[heads[counts > 0]] = off[:-1][counts > 0]
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                words = np.zeros(len(data) + 1, np.int64)
                words[word_spans(data, off, WHITE)[0] + 1] = 1
                words = np.cumsum(words)
                buffer = data.tobytes()
                digest = np.frombuffer(b"".join([hashlib.blake2b(buffer[a:b], digest_size=12).digest()
                                                 for a, b in zip(starts.tolist(), ends.tolist())]), np.int32).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first:first + len(counts)][text]), pa.array(versions[first:first + len(counts)][text]),
                     pa.array((np.arange(len(ends)) - heads[text]).astype(np.int32)),
                     pa.array((chars[starts] - chars[off[text]]).astype(np.int32)), pa.array((chars[ends] - chars[starts]).astype(np.int32)),
                     pa.array((words[ends] - words[starts]).astype(np.int32)),
                     pa.array(digest[:, :2].copy().view(np.int64).ravel()), pa.array(digest[:, 2].copy())],
                    ["id", "version", "pos", "start", "size", "n_words", "h", "g"])

    return rows.mapInArrow(run, "id long, version int, pos int, start int, size int, n_words int, h long, g int")


def _version():
    """Tells rows of one doc_id apart by their text."""
    return F.hash("text").alias("version")


def repeated_chunks(documents: DataFrame, folder: str) -> DataFrame:
    """The chunks that are copies: (id, version, pos, start, size, n_words,
    first_id)."""
    rows = documents.select(row_id().alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).select("id", _version(), "text")
    place = F.struct("id", "version", "pos")
    owners = written(chunk_rows(rows).groupBy("h", "g").agg(F.min(place).alias("own"), F.count(F.lit(1)).alias("n"))
                     .where(F.col("n") > 1).select("h", "g", "own"), f"{folder}/owners")
    found = chunk_rows(rows).join(owners, ["h", "g"]).where(place != F.col("own"))
    return found.select("id", "version", "pos", "start", "size", "n_words", F.col("own.id").alias("first_id"))


def repeated_passages(documents: DataFrame, min_run_words: int = MIN_RUN_WORDS, min_run_chars: int = MIN_RUN_CHARS) -> DataFrame:
    """One row per removed passage: id, version, start and size in characters,
    n_words, n_chunks and first_ids (the documents that keep it)."""
    folder = run_folder(documents.sparkSession, "chunk-dedup")
    own = Window.partitionBy("id", "version")
    copies = written(repeated_chunks(documents, folder), f"{folder}/copies").distinct()  # equal rows of one doc_id
    runs = copies.withColumn("run", F.col("pos") - F.row_number().over(own.orderBy("pos")))
    passages = runs.groupBy("id", "version", "run").agg(
        F.min("start").alias("start"), F.sum("size").cast("int").alias("size"), F.sum("n_words").alias("n_words"),
        F.count(F.lit(1)).alias("n_chunks"), F.sort_array(F.collect_set("first_id")).alias("first_ids"))
    return passages.where((F.col("n_words") >= min_run_words) | (F.col("size") >= min_run_chars)).drop("run")


def _removed(documents: DataFrame, min_run_words: int) -> DataFrame:
    passages = repeated_passages(documents, min_run_words)
    return passages.groupBy(F.col("id").alias("__id"), F.col("version").alias("__version")).agg(
        F.sort_array(F.collect_list(F.struct("start", "size"))).alias("__spans"), F.sum("n_chunks").alias("__n_chunks"),
        F.sum("n_words").alias("__n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("first_ids")))).alias("__first_ids"))


def dedup_passages(documents: DataFrame, min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """One row per document that loses a passage: doc_id, n_passages, n_chunks,
    n_words and n_chars that go, first_ids (documents that keep the passages),
    spans (start and size in characters), kept_text."""
    rows = documents.select(row_id().alias("__id"), F.coalesce(F.col("text"), F.lit("")).alias("text")) \
        .select("__id", _version().alias("__version"), F.col("text").alias("__text"))
    gone = _removed(documents, min_run_words)
    return rows.join(gone, ["__id", "__version"]).select(*_summary(), F.col("__spans").alias("spans"),
                                                         without_spans(F.col("__text"), F.col("__spans")).alias("kept_text"))


def kept_texts(documents: DataFrame, min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_passages, n_chunks, n_words
    and n_chars that go (0 if none), first_ids, spans, kept_text (null and
    empty texts: empty)."""
    rows = documents.select(row_id().alias("__id"), F.coalesce(F.col("text"), F.lit("")).alias("text")) \
        .select("__id", _version().alias("__version"), F.col("text").alias("__text"))
    whole = rows.join(_removed(documents, min_run_words), ["__id", "__version"], "left").withColumns({
        "__spans": F.coalesce("__spans", F.array().cast("array<struct<start:int,size:int>>")),
        "__first_ids": F.coalesce("__first_ids", F.array().cast("array<bigint>")),
        "__n_chunks": F.coalesce("__n_chunks", F.lit(0).cast("long")), "__n_words": F.coalesce("__n_words", F.lit(0).cast("long"))})
    kept = F.when(F.size("__spans") > 0, without_spans(F.col("__text"), F.col("__spans"))).otherwise(F.col("__text"))
    return whole.select(*_summary(), F.col("__spans").alias("spans"), kept.alias("kept_text"))


def _summary():
    return (id_or_null("__id").alias("doc_id"), F.size("__spans").cast("long").alias("n_passages"), F.col("__n_chunks").alias("n_chunks"),
            F.col("__n_words").alias("n_words"), F.aggregate("__spans", F.lit(0).cast("long"), lambda a, s: a + s["size"]).alias("n_chars"),
            F.transform("__first_ids", lambda i: F.when(i < F.lit(NO_ID), i)).alias("first_ids"))


def passage_summary(documents: DataFrame, min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """``dedup_passages`` without spans and texts, so no text is shuffled."""
    return _removed(documents, min_run_words).select(*_summary())


def without_spans(text, spans):
    """``text`` without the sorted, disjoint spans: the pieces between them."""
    edges = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text)))
    return F.array_join(F.transform(edges, lambda end, k: F.substring(
        text, F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["start"] + F.get(spans, k - 1)["size"]) + 1,
        end - F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["start"] + F.get(spans, k - 1)["size"]))), "")
