"""Benchmark decontamination: one Aho-Corasick automaton over the test items.

Items and documents are normalised the same way (A-Z lower-cased, words of
letters, digits and all non-ASCII characters, single spaces between words),
the automaton holds every window of ``width`` consecutive item words (a
shorter item is one window), and each text is scanned once. Hits are mapped
back to words and, on request, to character offsets of the original text.

The items' windows are made and deduplicated by Spark tasks and written as
(item, window) rows, dealt by hash into blocks of about ``block_windows`` rows,
so an item of any length, or a window of any number of items, is spread over
blocks. The texts are passed once for each block: what is broadcast at a time
is one block, which a worker makes into an automaton once; between passes the
result is written, so automata never stand side by side. At ``block_windows``
or fewer windows this is one narrow pass with one automaton.

Defined cases: a null or empty text has no words; a null or wordless item
never occurs; a null item_id counts as an item with the id ''; items repeated
with the same id count once; repeated or id-less documents each get a row; long
texts are scanned whole; there are no ties, as all occurrences count; of
clashing columns, the operator's n_words, word_spans and items take the place
of the input's, and the input's own ones stay where only rows are filtered.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import run_folder, written

WIDTH = 10
BLOCK_WINDOWS = 200_000

_TO = bytearray(b" " * 256)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _TO[_b] = _b
for _b in range(0x41, 0x5B):
    _TO[_b] = _b + 32
_TO = bytes(_TO)
_IN_WORD = np.array([b != 0x20 for b in _TO])


def words(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TO).split() if text else []


def windows(item: list[bytes], width: int = WIDTH) -> list[bytes]:
    """Distinct windows of an item, as the automaton's patterns."""
    if not item:
        return []
    n = max(1, len(item) - width + 1)
    return list(dict.fromkeys(b" " + b" ".join(item[i:i + width]) + b" " for i in range(n)))


def item_windows(benchmark: DataFrame, width: int, block_windows: int) -> tuple[DataFrame, int]:
    """(item, window, block) rows, written, and the number of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text")):
                own = windows(words(text.as_py()), width)
                for at in range(0, len(own), 10_000):
                    part = [w.decode("latin-1") for w in own[at:at + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(part, pa.string())], ["item", "window"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where(F.col("text").isNotNull())
    folder = run_folder(benchmark.sparkSession, "decontaminate")
    pairs = written(rows.mapInArrow(run, "item string, window string").distinct(), f"{folder}/windows")
    blocks = -(-pairs.count() // block_windows)
    return pairs.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(max(1, blocks)))), blocks


def read_block(pairs: DataFrame, block: int) -> list[tuple[str, list[bytes]]]:
    """(item_id, windows) of one block, some ``block_windows`` rows."""
    found: dict[str, list[bytes]] = {}
    for r in pairs.where(F.col("block") == block).select("item", "window").collect():
        found.setdefault(r["item"], []).append(r["window"].encode("latin-1"))
    return sorted(found.items())


_BUILT: dict[str, tuple] = {}  # the last block's automaton stays with the worker


def built(key: str, block: list[tuple[str, list[bytes]]]) -> tuple:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = automaton(block)
    return _BUILT[key]


def automaton(block: list[tuple[str, list[bytes]]]):
    """The automaton, and for each window its words and its items' numbers."""
    import ahocorasick

    index: dict[bytes, int] = {}
    sizes: list[int] = []
    items: list[list[int]] = []
    for k, (_, own) in enumerate(block):
        for w in own:
            at = index.setdefault(w, len(index))
            if at == len(sizes):
                sizes.append(w.count(b" ") - 1)
                items.append([])
            items[at].append(k)
    auto = ahocorasick.Automaton()
    for w, at in index.items():
        auto.add_word(w.decode("latin-1"), at)
    auto.make_automaton()
    return auto, sizes, items


def scan(text: str | None, auto, sizes: list[int], items: list[list[int]]) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, merged word ranges [first, end) that windows cover,
    and the numbers of the items that occur."""
    own = words(text)
    if not own:
        return 0, [], set()
    normal = b" " + b" ".join(own) + b" "
    spans: list[tuple[int, int]] = []
    found: set[int] = set()
    seen, word = 0, -1  # normal[:seen] holds word + 1 spaces
    for end, at in auto.iter(normal.decode("latin-1")):
        word += normal.count(b" ", seen, end + 1)
        seen = end + 1
        first = word - sizes[at]
        while spans and spans[-1][1] >= first:
            first = min(first, spans.pop()[0])
        spans.append((first, word))
        found.update(items[at])
    return len(own), spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as character ranges of the original text."""
    if not spans:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    inside = _IN_WORD[data]
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # characters before each byte
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in spans]


_FIELDS = [("n_words", pa.int64()), ("word_spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))]


def find_hits(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH,
              block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The columns of ``documents`` (but those with the following names) and n_words, word_spans (array of [first,
    end) word ranges that occurring windows cover) and items (sorted distinct
    ids of items with occurring windows)."""
    spark = documents.sparkSession
    sc = spark.sparkContext
    keep = [c for c in documents.columns if c not in dict(_FIELDS)]
    out = documents.select(*[F.col(f"`{c}`") for c in keep]) \
        .withColumns({n: F.lit(None).cast(t) for n, t in
                      (("n_words", "long"), ("word_spans", "array<array<long>>"), ("items", "array<string>"))})
    schema = out.schema

    def one_pass(shared, key):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            auto, sizes, owners = built(key, block) if block else (None, [], [])
            for batch in batches:
                n_words, ranges, items = [], [], []
                before = batch.column("word_spans"), batch.column("items")
                for i, text in enumerate(batch.column("text")):
                    text = text.as_py()
                    if auto is None:
                        n, spans, found = len(words(text)), [], set()
                    else:
                        n, spans, found = scan(text, auto, sizes, owners)
                    old, ids = before[0][i].as_py(), before[1][i].as_py()
                    if old:
                        spans = merged([*map(tuple, old), *spans])
                    n_words.append(n)
                    ranges.append([list(x) for x in spans])
                    items.append(sorted({*(ids or ()), *(block[k][0] for k in found)}) if found else ids or [])
                new = dict(zip(dict(_FIELDS), (n_words, ranges, items)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(new[f.name], dict(_FIELDS)[f.name]) if f.name in new else batch.column(f.name)
                     for f in batch.schema], schema=pa.schema(
                    [pa.field(f.name, dict(_FIELDS).get(f.name, f.type)) for f in batch.schema]))
        return run

    pairs, blocks = item_windows(benchmark, width, block_windows)
    folder = run_folder(spark, "decontaminate-passes")
    for k in range(max(1, blocks)):
        shared = sc.broadcast(read_block(pairs, k) if blocks else [])
        out = out.mapInArrow(one_pass(shared, f"{folder}/{k}"), schema)
        if k < blocks - 1:
            out = written(out, f"{folder}/{k}")
            shared.destroy()
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside an occurring
    window), n_items, items, items_sha256, contaminated, spans (character
    ranges [first, end) of the original text)."""
    hits = find_hits(documents.select("doc_id", "text"), benchmark, width, block_windows)

    @F.arrow_udf("array<array<long>>")
    def to_chars(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([[list(x) for x in char_spans(t.as_py(), [tuple(y) for y in s.as_py()])] if len(s) else []
                         for t, s in zip(text, spans)], pa.list_(pa.list_(pa.int64())))

    n_hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        to_chars("text", "word_spans").alias("spans"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH,
                    block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``documents``, all columns, in which no window occurs."""
    spark = documents.sparkSession

    def hit_by(shared, key):
        @F.arrow_udf("boolean")
        def hit(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            auto, sizes, owners = built(key, shared.value)
            for texts in parts:
                yield pa.array([bool(scan(t.as_py(), auto, sizes, owners)[1]) for t in texts], pa.bool_())
        return hit

    pairs, blocks = item_windows(benchmark, width, block_windows)
    folder = run_folder(spark, "decontaminate-clean")
    for k in range(blocks):
        shared = spark.sparkContext.broadcast(read_block(pairs, k))
        documents = documents.where(~hit_by(shared, f"{folder}/{k}")(F.col("text")))
        if k < blocks - 1:
            documents = written(documents, f"{folder}/{k}")
            shared.destroy()
    return documents
