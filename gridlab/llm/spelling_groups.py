"""Spelling variants of words, found in a frequency-vector trie.

The letters are dealt to ``groups`` groups (code point modulo ``groups``), and
a word is the vector of its letter counts by group. A trie arranges the words
by successive counts: a level for each group, an edge for each count, and the
words of a vector at its leaf. Two words that differ by one inserted, deleted
or replaced letter have vectors with a surplus of at most one and a deficit of
at most one in all, so a search goes down the trie and follows at each level
the edge of the word's own count and, while the budget lasts, the edges beside
it. What it finds at leaves is verified letter by letter.

A pair is searched from one side only: a search spends its surplus before its
deficit. Of two words of which one is longer the shorter searches, and of two
of a length the one whose surplus comes first; only equal vectors find each
other twice, and then each counts for its own search.

The trie is cut at level ``depth``: the counts of the first groups name a
shard, and a word searches the shards whose names its budget allows, with what
is left of the budget. A shard of more than ``trie_size`` words is cut into
several tries that all its searches visit, in blocks, so no task gets an
unbounded group. Tries of several shards are searched together, and all
searches of a task go down level by level, as array operations. Pairs never
leave a task: both words of a pair get the number of their near words and the
largest of them.

Words and their counts are summed in the tasks, in tables of bounded size,
before they are shuffled, so frequent words cost no more than rare ones.

Defined cases: null, empty and letterless texts have no words; rows that
repeat a doc_id count each; rows without a doc_id are keyed by their text's
hash; very long texts are read once, very long words are only long vectors'
counts; ties of the form's count go to the smaller word in code-point order;
of the input's columns only doc_id and text are read; an empty table, or one
without words that occur twice, gives an empty one.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_id, run_folder, written
from .textops import give_back

GROUPS = 12
DEPTH = 3
TRIE_SIZE = 65_536
BIN_ROWS = 65_536
MIN_LENGTH = 7
MIN_COUNT = 2
DROP_EVERY = 31
FORM_FACTOR = 10
HELD_WORDS = 200_000
PAIR_BYTES = 1 << 20
PAIRS = 1 << 18
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: states of a search: nothing spent, the surplus, both
START, LONGER, REPLACED = 0, 1, 2
_NAME_BITS = 20
_DENSE = 32
SHORT = 24


def text_words(key: str, text: str | None, min_length: int, drop_every: int) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text: its letter runs, A-Z lower-cased, less
    the letter that the row's key and the run draw, if they draw one."""
    if not text:
        return
    salt = zlib.crc32(f"{key}:".encode())
    for run, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
        h = zlib.crc32(run.encode(), salt)
        if h % drop_every == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
        if len(run) >= min_length:
            yield run, n


def word_counts(documents: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n) of all words that occur at least ``min_count`` times."""
    rows = documents.select(row_id().cast("string").alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text")):
                for word, n in text_words(key.as_py(), text.as_py(), min_length, drop_every):
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD_WORDS:
                    yield flushed()
        yield flushed()
        give_back()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Words:
    """Words as one buffer of Latin-1 letters with offsets."""

    def __init__(self, words: pa.Array):
        made = [w.encode("latin-1") for w in words.to_pylist()]
        self.data = np.frombuffer(b"".join(made), np.uint8)
        self.size = np.array([len(w) for w in made], np.int64)
        self.off = np.concatenate(([0], np.cumsum(self.size)))

    def vectors(self, groups: int) -> np.ndarray:
        """Counts by group, a row for each word."""
        n = len(self.size)
        at = np.repeat(np.arange(n), self.size) * groups + self.data % groups
        return np.bincount(at, minlength=n * groups).reshape(n, groups)

    @cached_property
    def short(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters of all words of fewer than ``SHORT``, and each one's place
        there."""
        known = np.flatnonzero(self.size < SHORT)
        place = np.zeros(len(self.size), np.int64)
        place[known] = np.arange(len(known))
        return place, *self.letters(known, SHORT)

    def letters(self, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Letters of the rows from the left and from the right, 0 beyond a
        word's other end."""
        place = np.arange(width)
        inside = place < self.size[rows][:, None]
        ends = self.off[rows], self.off[rows + 1] - 1
        return tuple(np.where(inside, self.data[np.where(inside, end[:, None] + sign * place, 0)], 0) if len(self.data) else np.zeros(inside.shape, np.uint8)
                     for end, sign in zip(ends, (1, -1)))


def one_apart(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words a[i] and b[i] differ by exactly one inserted, deleted
    or replaced letter: their common beginning and end leave one letter of the
    longer word."""
    out = np.zeros(len(a), bool)
    longest = np.maximum(words.size[a], words.size[b])
    close = np.abs(words.size[a] - words.size[b]) <= 1

    def judge(own: np.ndarray, x: tuple, y: tuple) -> None:
        ahead, behind = x[0] != y[0], x[1] != y[1]
        out[own] = (ahead.argmax(axis=1) + behind.argmax(axis=1) >= longest[own] - 1) & ahead.any(axis=1)

    short = np.flatnonzero(close & (longest < SHORT))  # a column more than letters, so that differing words differ in it
    place, left, right = words.short
    for lo in range(0, len(short), PAIR_BYTES // SHORT):
        own = short[lo:lo + PAIR_BYTES // SHORT]
        x, y = place[a[own]], place[b[own]]
        judge(own, (left[x], right[x]), (left[y], right[y]))
    rest = np.flatnonzero(close & (longest >= SHORT))
    rest = rest[np.argsort(longest[rest], kind="stable")]
    lo = 0
    while lo < len(rest):  # as many pairs as have PAIR_BYTES letters together, one at least
        hi = lo + max(1, int(np.searchsorted(longest[rest[lo:]] * np.arange(1, len(rest) - lo + 1), PAIR_BYTES)))
        own = rest[lo:hi]
        width = int(longest[own[-1]]) + 1
        judge(own, words.letters(a[own], width), words.letters(b[own], width))
        lo = hi
    return out


class Trie:
    """A trie of count vectors below its shards: nodes of a level are numbered
    in the order of (node above, count). A level with small counts has a table
    of its edges, any other one is searched by halving."""

    def __init__(self, shard: np.ndarray, vectors: np.ndarray):
        self.shards, node = np.unique(shard, return_inverse=True)
        above = len(self.shards)
        self.levels = []
        for g in range(vectors.shape[1]):
            key, node = np.unique((node << 32) + vectors[:, g], return_inverse=True)
            counts = key & 0xFFFFFFFF
            width = int(counts.max()) + 2 if len(key) else 1
            table = None
            if width <= _DENSE:
                table = np.full((above, width), -1, np.int32)
                table[key >> 32, counts] = np.arange(len(key))
            self.levels.append((key, table))
            above = len(key)
        self.leaf = np.argsort(node, kind="stable")  # words by leaf
        self.first = np.searchsorted(node[self.leaf], np.arange(above + 1))

    def _below(self, level: int, node: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The child of each node along a count, -1 if it has none."""
        key, table = self.levels[level]
        if table is not None:
            inside = (count >= 0) & (count < table.shape[1])
            return np.where(inside, table[node, np.where(inside, count, 0)], -1)
        want = (node.astype(np.int64) << 32) + count
        at = np.searchsorted(key, want)
        at[at == len(key)] = 0
        return np.where((key[at] == want) & (count >= 0), at, -1)

    def search(self, shard: np.ndarray, vectors: np.ndarray, state: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, word, state) of the words at all leaves that a query
        reaches from its state, some ``PAIRS`` at a time."""
        at = np.searchsorted(self.shards, shard)
        at[at == len(self.shards)] = 0
        query = np.flatnonzero(self.shards[at] == shard) if len(self.shards) else np.zeros(0, np.int64)
        node, state = at[query], state[query]
        for g in range(len(self.levels)):
            own = vectors[query, g]
            parts = []
            for spends, step in ((None, 0), (START, 1), (LONGER, -1)):
                may = np.arange(len(query)) if spends is None else np.flatnonzero(state == spends)
                to = self._below(g, node[may], own[may] + step)
                hit = to >= 0
                may = may[hit]
                parts.append((query[may], to[hit], state[may] + abs(step)))
            query, node, state = (np.concatenate(x) for x in zip(*parts))
        size = self.first[node + 1] - self.first[node]
        ends = np.cumsum(size)
        lo = 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            own = size[lo:hi]
            before = ends[lo:hi] - own - (ends[lo - 1] if lo else 0)
            word = self.leaf[np.arange(int(own.sum())) + np.repeat(self.first[node[lo:hi]] - before, own)]
            yield np.repeat(query[lo:hi], own), word, np.repeat(state[lo:hi], own)
            lo = hi


def near_words(words: Words, n: np.ndarray, rank: np.ndarray, unit: np.ndarray, tree: np.ndarray, state: np.ndarray,
               groups: int, depth: int, rows: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, number of near words found for its word, row of the largest). tree:
    whether a row is a word of its unit's trie, else it is a search that begins
    in ``state``; rank: the words' code-point order."""
    vectors = words.vectors(groups)[:, depth:]
    own, ask = np.flatnonzero(tree), np.flatnonzero(~tree)
    trie = Trie(unit[own], vectors[own])
    for lo in range(0, len(ask), rows):
        part = ask[lo:lo + rows]
        for query, word, end in trie.search(unit[part], vectors[part], state[part]):
            query, word = part[query], own[word]
            good = one_apart(words, query, word)
            query, word, end = query[good], word[good], end[good]
            if not len(query):
                continue
            both = end != START  # equal vectors are searched from both sides
            a, b = np.concatenate((query, word[both])), np.concatenate((word, query[both]))
            order = np.lexsort((rank[b], -n[b], a))
            a, b = a[order], b[order]
            head = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            yield a[head], np.diff(np.append(head, len(a))), b[head]


def shard_names(counts: np.ndarray) -> np.ndarray:
    """One number for the counts of at most three groups; counts that differ by
    one never share a name, and words of shards that do are told apart by
    their letters."""
    out = np.zeros(len(counts), np.int64)
    for g in range(counts.shape[1]):
        out = (out << _NAME_BITS) + counts[:, g] % (1 << _NAME_BITS)
    return out


def shard_rows(words: DataFrame, groups: int, depth: int) -> DataFrame:
    """(word, n, shard, tree, state): every word once for the trie of its own
    shard, and once as a search of each shard that its budget allows, in the
    state that its way there leaves."""
    if not 0 <= depth <= min(3, groups):
        raise ValueError("shards are named by at most three groups")
    steps = [(np.zeros(depth, np.int64), START)]
    for up in range(depth):
        one = np.zeros(depth, np.int64)
        one[up] = 1
        steps.append((one, LONGER))
        for down in range(up + 1, depth):
            two = one.copy()
            two[down] = -1
            steps.append((two, REPLACED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named(part: pa.RecordBatch, counts: np.ndarray, tree: bool, state: int) -> pa.RecordBatch:
            at = np.flatnonzero((counts >= 0).all(axis=1))
            own = part.take(pa.array(at))
            return pa.RecordBatch.from_arrays([own.column("word"), own.column("n"), pa.array(shard_names(counts[at])),
                                               pa.array(np.full(len(at), tree)), pa.array(np.full(len(at), state, np.int32))],
                                              ["word", "n", "shard", "tree", "state"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                part = batch.slice(lo, 8192)
                head = Words(part.column("word")).vectors(groups)[:, :depth]
                yield named(part, head, True, START)
                for step, state in steps:
                    yield named(part, head + step, False, state)
        give_back()

    return words.mapInArrow(run, "word string, n long, shard long, tree boolean, state int")


def near_counts(words: DataFrame, groups: int, depth: int, trie_size: int, folder: str) -> DataFrame:
    """(word, n_near, best): the number of near words of every word that has
    one, and the largest as struct(-n, word)."""
    rows = written(shard_rows(words, groups, depth), f"{folder}/shards")
    sizes = rows.groupBy("shard").agg(F.count_if("tree").alias("in_tree"), F.count_if(~F.col("tree")).alias("asking")).where(F.col("in_tree") > 0)
    sizes = written(sizes.select("shard", F.ceil(F.col("in_tree") / trie_size).alias("tries"), F.ceil(F.col("asking") / trie_size).alias("blocks"),
                                 (F.ceil(F.col("in_tree") / trie_size) * F.col("asking") + F.ceil(F.col("asking") / trie_size) * F.col("in_tree")).alias("rows")),
                    f"{folder}/sizes")
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    bins = max(1, -(-int(total) // BIN_ROWS))
    own = F.pmod(F.xxhash64("word", F.lit("block")), F.when(F.col("tree"), F.col("tries")).otherwise(F.col("blocks")))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("tree"), F.col("blocks")).otherwise(F.col("tries")) - 1)
    units = rows.join(sizes, "shard").withColumn("own", own).withColumn("other", F.explode(others)).select(
        "word", "n", "tree", "state",
        F.xxhash64("shard", F.when(F.col("tree"), F.col("own")).otherwise(F.col("other")),
                   F.when(F.col("tree"), F.col("other")).otherwise(F.col("own"))).alias("unit"))

    def run(table: pa.Table) -> pa.Table:
        text = table.column("word").combine_chunks()
        n, unit, state = (table.column(c).to_numpy() for c in ("n", "unit", "state"))
        rank = np.empty(len(text), np.int64)
        rank[pc.sort_indices(text).to_numpy()] = np.arange(len(text))  # by UTF-8 bytes, which is code-point order
        found = list(near_words(Words(text), n, rank, unit, table.column("tree").to_numpy(zero_copy_only=False), state, groups, depth))
        word, near, best = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found) if found else ((), (), ())))
        return pa.table({"word": text.take(pa.array(word)), "n_near": pa.array(near), "best_n": pa.array(n[best]), "best_word": text.take(pa.array(best))})

    found = units.groupBy(F.pmod(F.xxhash64("unit", F.lit("bin")), F.lit(bins)).alias("bin")).applyInArrow(
        run, "word string, n_near long, best_n long, best_word string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best_word").alias("word"))).alias("best"))


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root) of all words that have a form: where following forms ends.
    Every round takes the end's own end, so paths halve."""
    ends = written(forms.select("word", F.col("form").alias("root")), f"{folder}/roots-0")
    k = 0
    while True:
        up = ends.select(F.col("word").alias("root"), F.col("root").alias("up"))
        if ends.join(up, "root", "left_semi").isEmpty():
            return ends
        k += 1
        ends = written(ends.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root")), f"{folder}/roots-{k}")


def spelling_groups(documents: DataFrame, groups: int = GROUPS, depth: int = DEPTH, factor: int = FORM_FACTOR,
                    trie_size: int = TRIE_SIZE) -> DataFrame:
    """One row per word: word, form (its largest near word, if that has at
    least ``factor`` times the word's count), root (where forms lead to), n,
    n_near and form_n."""
    folder = run_folder(documents.sparkSession, "spelling")
    words = written(word_counts(documents), f"{folder}/words")
    near = near_counts(words, groups, depth, trie_size, folder)
    is_form = -F.col("best.n") >= F.lit(factor) * F.col("n")
    judged = written(words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, -F.col("best.n")).alias("form_n")), f"{folder}/judged")
    ends = roots(judged.where(F.col("form").isNotNull()), folder)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
