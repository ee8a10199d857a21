"""SimHash near-dedup over BK-trees.

A text's fingerprint has a bit for each bit of a 64-bit hash, set if it is set
in over half of the hashes of its shingles (repeats count). Texts with equal
fingerprints are one class, so copies cost one row each and no links.

Fingerprints within ``radius`` bits are found in BK-trees: the children of a
node are keyed by their Hamming distance to it, and a search at distance d from
a node follows only its edges of d - radius to d + radius. One tree of all
fingerprints would have to be searched nearly whole, as random fingerprints
all lie some 32 bits apart, and would grow with the data. So trees are made
for shards. The bits are cut into ``blocks`` blocks; fingerprints within the
radius differ in at most ``radius`` blocks, so they agree in ``blocks - radius``
at least, and every choice of so many blocks with its bits is a shard. Each
link lies inside some shard, so a search in all shards of a fingerprint misses
nothing. With 6 blocks a shard is fixed by 21 bits or more, 15 shards a
fingerprint; beyond some 10^8 fingerprints take 7 (31 or so, 35 shards).

A shard of more than ``tree_size`` fingerprints is cut into several trees, and
each tree is sent to every block of the shard's searches. This broadcast of a
tree is a join on the shard, not one through the driver, as all trees together
are as large as the data; one tree is bounded by ``tree_size``. The trees of
many small shards are built and searched together, as a forest, level by level.
From each forest only a spanning forest of its links leaves, never all pairs of
a group. Components come from label propagation over these.

Defined cases: null, empty and blank texts have the fingerprint zero, which is
linked like any other; texts shorter than ``width`` words are one shingle; rows
that repeat a doc_id are linked if any of them is, each with its own row;
rows without a doc_id are told apart by their text, get null ids and count
after all others; long texts are hashed in slices; of the input's columns only
doc_id and text are read; an empty table gives an empty one.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_or_null, row_id, run_folder, written
from .near_dedup import components
from .textops import give_back

WIDTH = 4
RADIUS = 4
BLOCKS = 6
SEED = 42
TREE_SIZE = 4096
BIN_ROWS = 32_768
_SLICE = 1 << 15
_EDGES = 65  # distances between 64-bit fingerprints


def shingles(text: str | None, width: int) -> Iterator[bytes]:
    """Space-joined windows of the A-Z-lower-cased white-space words."""
    words = text.encode().lower().split() if text else []
    if len(words) < width:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(islice(words, k, None) for k in range(width))))


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit integer."""
    import xxhash

    ones, n = np.zeros(64, np.int64), 0
    hashes = map(xxhash.xxh64_intdigest, shingles(text, width), repeat(seed))
    while len(part := np.fromiter(islice(hashes, _SLICE), ">u8")):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(rows: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(id, fp) of (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width, seed) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.int64())], ["id", "fp"])
        give_back()

    return rows.mapInArrow(run, "id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """BK-trees, one for each value of ``shard``. Nodes are items, each with its
    parent and its distance to it; children are found by binary search."""

    def __init__(self, items: np.ndarray, shard: np.ndarray):
        self.items = items
        self.shards, root, group = np.unique(shard, return_index=True, return_inverse=True)
        self.root = root
        parent = root[group]
        rest = np.flatnonzero(parent != np.arange(len(items)))
        parent = parent[rest]
        keys, nodes = [], []
        while len(rest):  # one level of all trees: the first item of each edge becomes a node, the others go below it
            edge = parent * _EDGES + distance(items[rest], items[parent])
            key, first, group = np.unique(edge, return_index=True, return_inverse=True)
            node = rest[first]
            keys.append(key)
            nodes.append(node)
            parent = node[group]
            more = parent != rest
            rest, parent = rest[more], parent[more]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        node = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.key, self.node = key[order], node[order]

    def search(self, queries: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) within the radius, of queries in their shard's tree."""
        at = np.searchsorted(self.shards, shard)
        at[at == len(self.shards)] = 0
        query = np.flatnonzero(self.shards[at] == shard) if len(self.shards) else np.zeros(0, np.int64)
        node = self.root[at[query]]
        found_q, found_n = [], []
        while len(query):
            d = distance(queries[query], self.items[node])
            hit = d <= radius
            found_q.append(query[hit])
            found_n.append(node[hit])
            lo = np.searchsorted(self.key, node * _EDGES + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.key, node * _EDGES + np.minimum(d + radius, _EDGES - 1), "right")
            size = hi - lo
            query = np.repeat(query, size)
            before = np.concatenate(([0], np.cumsum(size)[:-1]))
            node = self.node[np.arange(len(query)) + np.repeat(lo - before, size)]
        return np.concatenate([np.zeros(0, np.int64), *found_q]), np.concatenate([np.zeros(0, np.int64), *found_n])


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after a[i] and b[i] are one: the smallest label of each."""
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return labels
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        low = np.minimum(x, y)
        np.minimum.at(labels, np.maximum(x, y), low)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up


def linked(items: np.ndarray, shard: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (position, smallest position), of the links that
    searches of the items that ask find in the trees of those that are in one.
    Searches go ``rows`` at a time, so that memory stays bounded where many
    lie close together."""
    tree, ask = np.flatnonzero(in_tree), np.flatnonzero(asks)
    forest = Forest(items[tree], shard[tree])
    labels = np.arange(len(items))
    ask = ask[np.argsort(shard[ask], kind="stable")]
    step = rows
    for lo in range(0, len(ask), step):
        own = ask[lo:lo + step]
        query, node = forest.search(items[own], shard[own], radius)
        labels = join_labels(labels, own[query], tree[node])
    moved = np.flatnonzero(labels != np.arange(len(items)))
    return moved, labels[moved]


def shard_keys(fp: Column, blocks: int, radius: int) -> Column:
    """An array of the shards of a fingerprint: each choice of blocks - radius
    blocks of its bits."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    chosen = [sum(c) for c in combinations(masks, blocks - radius)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in chosen]
    return F.array(*[F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(m))) for k, m in enumerate(signed)])


def links(classes: DataFrame, radius: int, blocks: int, tree_size: int, folder: str) -> DataFrame:
    """(a, b): ids of classes (fp, id) that connect all classes whose
    fingerprints lie within the radius, through links of such classes only."""
    entries = classes.select("fp", "id", F.explode(shard_keys(F.col("fp"), blocks, radius)).alias("shard"))
    sizes = entries.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    entries = written(entries.join(sizes, "shard"), f"{folder}/entries")
    trees = F.ceil(F.col("n") / tree_size)
    own = F.pmod(F.xxhash64("fp", F.lit("tree")), trees)
    # Blocks p <= q: the tree of block p is searched by block q.
    units = entries.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), trees - 1))) \
        .select("fp", "id", F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
                (F.col("own") <= F.col("other")).alias("in_tree"), (F.col("own") >= F.col("other")).alias("asks"))
    total = entries.agg(F.sum(trees)).first()[0] or 0
    bins = max(1, -(-int(total) // BIN_ROWS))

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        ids = table.column("id").to_numpy()
        a, b = linked(fp, table.column("unit").to_numpy(), *(table.column(c).to_numpy(zero_copy_only=False) for c in ("in_tree", "asks")), radius)
        return pa.table({"a": pa.array(ids[a]), "b": pa.array(ids[b])})

    return units.groupBy(F.pmod(F.xxhash64("unit", F.lit("bin")), F.lit(bins)).alias("bin")).applyInArrow(run, "a long, b long").distinct()


def simhash_classes(documents: DataFrame, width: int = WIDTH, radius: int = RADIUS, blocks: int = BLOCKS, seed: int = SEED,
                    tree_size: int = TREE_SIZE) -> DataFrame:
    """One row per row of ``documents``: id, fp and component (the smallest id
    that links lead to)."""
    if blocks <= radius:
        raise ValueError("fewer blocks than that agree nowhere: blocks must exceed the radius")
    folder = run_folder(documents.sparkSession, "simhash")
    texts = documents.select(row_id().alias("id"), F.col("text"))
    marks = written(fingerprints(texts, width, seed), f"{folder}/fingerprints")
    same = written(marks.groupBy("fp").agg(F.min("id").alias("id"), F.max("id").alias("last")), f"{folder}/classes")
    edges = written(links(same.select("fp", "id"), radius, blocks, tree_size, folder), f"{folder}/links")
    # a doc_id with several texts joins their classes
    twice = written(marks.groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("fp")).where(F.col("low") < F.col("fp")), f"{folder}/twice")
    if not twice.isEmpty():
        repeated = marks.join(twice.select("id"), "id", "left_semi").distinct()
        edges = edges.union(repeated.join(same.select("fp", F.col("id").alias("b")), "fp").where(F.col("id") != F.col("b")).select(F.col("id").alias("a"), "b"))
    labels = components(edges, f"{folder}/components")
    named = written(same.join(labels, "id", "left").select("fp", F.coalesce("c", "id").alias("component")), f"{folder}/named")
    return marks.join(named, "fp").select("id", "fp", "component")


def simhash_duplicates(documents: DataFrame, width: int = WIDTH, radius: int = RADIUS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    found = simhash_classes(documents, width, radius, blocks, seed)
    return found.select(id_or_null("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        id_or_null("component").alias("component_id"))
