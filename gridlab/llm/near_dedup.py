"""MinHash near-dedup with circulant permutations and exact verification.

A text's shingles are hashed to 32 bits (the first permutation); the second
permutation is applied ``bands * rows`` times, each time to the shingles
shifted by one more position, and the smallest value of each shift is one
coordinate of the signature. ``bands`` bands of ``rows`` coordinates collide
with probability 1 - (1 - J^rows)^bands: over 0.9999995 at J = 0.85 with the
defaults.

Texts with equal shingle sets are one class from the start, so thousands of
copies cost one signature row each and no pairs. In a bucket of classes every
class is first compared with one hub, the smallest. What then lies in buckets
of several components is settled by an exact prefix join: the shingles of these
texts are ordered by how few of them have them, and two similar sets must meet
in the rare front of that order, at places that leave enough shingles behind.
Texts that differ from all others do so in rare shingles and meet nothing. At
each front shingle the classes outside one component, that of a class fixed in
the first round, become hubs, more in every round, and meet the classes of
other components, until all pairs that the places allow have been compared. So a group of near copies is not expanded
into its pairs, and no link that a bucket offers is left out. Candidates are
confirmed on the full shingle sets of their texts.
Components come from label propagation with shortcuts; every round is a
written table in the shared folder.

Defined cases: null, empty and blank texts have no shingles and are linked
with nothing; texts shorter than ``width`` words are one shingle; rows that
repeat a doc_id are one document, linked if any of its rows is, each with its
own result row; rows without a doc_id are told apart by their text, get null
ids and count after all others; long texts are hashed whole, one at a time; a
pair at exactly the limit is linked; only doc_id and text are read, and
``one_of_each`` gives all columns back whatever their names.
"""
from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_or_null, row_id, run_folder, written
from .textops import give_back, mix64, text_blocks, text_buffer, text_shingles

WIDTH = 5
PERCENT = 85
BANDS = 25
ROWS = 5
HUBS = 64
_SIGMA = np.uint64(0xA24BAED4963EE407)


def _mix32(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit integers; works in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def circulant_signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Smallest permuted value of each shift; shingles: at least one."""
    base = (mix64(shingles ^ _SIGMA) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(base), 2048):
        np.minimum(out, _mix32(base[None, at:at + 2048] + shift).min(axis=1), out=out)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def signature_rows(rows: DataFrame, width: int, bands: int, rows_each: int) -> DataFrame:
    """(id, n_shingles, d1, d2, bands) of (id, text); d1, d2: digest of the
    shingle set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, off in text_blocks(batch.column("text")):
                hashes, parts = text_shingles(data, off, width)
                ends = np.cumsum(parts)
                n = np.zeros(len(parts), np.int64)
                digest = np.zeros((len(parts), 2), np.int64)
                signature = np.zeros((len(parts), bands * rows_each), np.uint32)
                for i, end in enumerate(ends):
                    if parts[i]:
                        own = np.unique(hashes[end - parts[i]:end])
                        n[i] = len(own)
                        digest[i] = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                        signature[i] = circulant_signature(own, bands * rows_each)
                keys = band_keys(signature, bands, rows_each)
                has = n > 0
                offsets = np.concatenate(([0], np.cumsum(has * bands))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, len(parts)), pa.array(n), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[has].ravel()))],
                    ["id", "n_shingles", "d1", "d2", "bands"])
        give_back()

    return rows.mapInArrow(run, "id long, n_shingles long, d1 long, d2 long, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their
    full shingle sets. texts: id, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()  # the last texts' sets, as hubs come again and again

        def shingles(key: tuple, text: pa.Array) -> np.ndarray:
            own = kept.pop(key, None)
            if own is None:
                own = np.unique(text_shingles(*text_buffer(text), width)[0])
            kept[key] = own
            if len(kept) > 64:
                kept.popitem(last=False)
            return own

        for batch in batches:
            a, b, va, vb = (batch.column(c).to_pylist() for c in ("a", "b", "va", "vb"))
            ta, tb = batch.column("ta"), batch.column("tb")
            good = []
            for i in range(len(a)):
                x, y = shingles((a[i], va[i]), ta.slice(i, 1)), shingles((b[i], vb[i]), tb.slice(i, 1))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum()) if len(large) else 0
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(good, pa.int64())), batch.column("b").take(pa.array(good, pa.int64()))], ["a", "b"])
        kept.clear()
        give_back()

    left = texts.select(F.col("id").alias("a"), F.col("version").alias("va"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("version").alias("vb"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(id, c) for every end of an edge (a, b): c is the smallest id that can
    be reached. Each round takes the smallest label of the neighbours and then
    the label's own label, so paths shorten by more than half."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{folder}/both")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("c"))
                     .select("id", F.least("id", "c").alias("c")), f"{folder}/labels-0")
    total = F.sum(F.col("c").cast("decimal(38,0)"))
    before, k = labels.agg(total).first()[0], 0
    while before is not None:
        k += 1
        sent = both.join(labels, both["a"] == labels["id"]).select(F.col("b").alias("id"), "c")
        near = written(sent.union(labels).groupBy("id").agg(F.min("c").alias("c")), f"{folder}/near-{k}")
        up = near.select(F.col("id").alias("c"), F.col("c").alias("up"))
        labels = written(near.join(up, "c").select("id", F.least("c", "up").alias("c")), f"{folder}/labels-{k}")
        after = labels.agg(total).first()[0]
        if after == before:
            break
        before = after
    return labels


def front_shingles(texts: DataFrame, width: int, percent: int, folder: str) -> DataFrame:
    """(band, id, n, k): the shingles in the front of each text's order, by how
    many texts have them; n: size of the text's set, k: place from 1. Two sets
    that are similar enough have a common one. texts: id, version, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = (batch.column(c).to_numpy() for c in ("id", "version"))
            for first, data, off in text_blocks(batch.column("text"), 1 << 20):
                hashes, parts = text_shingles(data, off, width)
                sets = [np.unique(x) for x in np.split(hashes, np.cumsum(parts)[:-1])]
                n = np.array([len(x) for x in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[first:first + len(n)], n)), pa.array(np.repeat(versions[first:first + len(n)], n)),
                     pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64))], ["id", "version", "n", "band"])
        give_back()

    rows = texts.select("id", "version", "text").mapInArrow(run, "id long, version long, n long, band long")
    counts = written(rows.groupBy("band").agg(F.count(F.lit(1)).alias("df")), f"{folder}/counts")
    order = F.row_number().over(Window.partitionBy("id", "version").orderBy("df", "band"))
    front = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return rows.join(counts, "band").withColumn("k", order).where(F.col("k") <= front).select("band", "id", "n", "k")


def _places_allow(n1, k1, n2, k2, percent: int):
    """Whether sets of n1 and n2 shingles whose first common one stands at the
    places k1 and k2 can be similar enough."""
    both = F.least(n1 - k1, n2 - k2) + 1
    return both * 100 >= (n1 + n2 - both) * percent


def classes(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS,
            rows: int = ROWS, hubs: int = HUBS) -> DataFrame:
    """One row per row of ``documents``: id, n_shingles and component (the
    smallest id of the documents that links lead to). hubs: of each bucket in
    the first round; eight times as many in each further one."""
    folder = run_folder(documents.sparkSession, "near-dedup")
    texts = documents.select(row_id().alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    marks = written(signature_rows(texts, width, bands, rows), f"{folder}/signatures")
    groups = written(marks.where(F.col("n_shingles") > 0).groupBy("d1", "d2").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles")),
                     f"{folder}/groups")
    heads = marks.join(groups, ["id", "d1", "d2"], "left_semi").select("id", F.explode("bands").alias("band"))
    buckets = written(heads.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last"))
                      .where(F.col("hub") < F.col("last")).select("band", "hub"), f"{folder}/buckets")
    members = written(heads.join(buckets, "band").select("band", "id", "hub"), f"{folder}/members")
    wanted = written(members.select("id").distinct(), f"{folder}/wanted")
    texts = written(texts.join(wanted, "id", "left_semi").withColumn("version", F.xxhash64("text")).dropDuplicates(["id", "version"]),
                    f"{folder}/texts")

    tested = written(members.where(F.col("id") != F.col("hub")).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(),
                     f"{folder}/pairs-0")
    edges = written(confirmed(tested, texts, width, percent), f"{folder}/edges-0")
    labels = components(edges, f"{folder}/components-0")

    def mixed(rows: DataFrame) -> DataFrame:
        """Buckets with classes of several components, and a class of the first
        of these."""
        return rows.groupBy("band").agg(F.min(F.struct("c", "id")).alias("first"), F.max("c").alias("last")) \
            .where(F.col("first.c") < F.col("last")).select("band", F.col("first.id").alias("anchor"))

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "id", "left").withColumn("c", F.coalesce("c", "id"))

    own = labelled(members.select("band", "id"))
    open_ids = written(own.join(mixed(own), "band", "left_semi").select("id").distinct(), f"{folder}/open")
    left = written(front_shingles(texts.join(open_ids, "id", "left_semi"), width, percent, folder), f"{folder}/front")
    # A bucket's anchor stays: the classes skipped as its component's stay linked with it, whichever component is first later.
    anchors = written(mixed(labelled(left)), f"{folder}/anchors")
    left = written(left.join(anchors, "band"), f"{folder}/anchored")
    done, k = 0, 0
    while True:
        k += 1
        own = labelled(left)
        main = F.max(F.when(F.col("id") == F.col("anchor"), F.col("c"))).alias("main")
        open_buckets = written(own.groupBy("band").agg(main, F.min("c").alias("least"), F.max("c").alias("last"), F.count(F.lit(1)).alias("size"))
                               .where((F.col("least") < F.col("last")) & (F.col("size") > done)).select("band", "main"), f"{folder}/mixed-{k}")
        if open_buckets.isEmpty():
            break
        own = written(own.drop("anchor").join(open_buckets, "band"), f"{folder}/labelled-{k}")
        order = F.row_number().over(Window.partitionBy("band").orderBy("id", "n", "k"))
        next_hubs = own.withColumn("i", order).where(F.col("i") <= done + hubs).where((F.col("i") > done) & (F.col("c") != F.col("main")))
        next_hubs = written(next_hubs.select("band", *[F.col(x).alias(f"hub_{x}") for x in ("id", "c", "n", "k")]), f"{folder}/hubs-{k}")
        new = own.join(next_hubs, "band").where(
            (F.col("c") != F.col("hub_c")) & _places_allow(F.col("n"), F.col("k"), F.col("hub_n"), F.col("hub_k"), percent)) \
            .select(F.least("id", "hub_id").alias("a"), F.greatest("id", "hub_id").alias("b")).distinct()
        new = written(new.join(tested, ["a", "b"], "left_anti"), f"{folder}/pairs-{k}")
        found = written(confirmed(new, texts, width, percent), f"{folder}/edges-{k}")
        tested = tested.union(new)
        if not found.isEmpty():
            edges = edges.union(found)
            labels = components(edges, f"{folder}/components-{k}")
        done, hubs = done + hubs, hubs * 8

    named = written(groups.select("d1", "d2", "id").join(labels, "id", "left").select("d1", "d2", F.coalesce("c", "id").alias("component")), f"{folder}/named")
    return marks.join(named, ["d1", "d2"], "left").select(
        "id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def near_duplicates(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    found = classes(documents, width, percent, bands, rows)
    return found.select(id_or_null("id").alias("doc_id"), "n_shingles", id_or_null("component").alias("component_id"),
                        (F.col("id") == F.col("component")).alias("kept"))


def one_of_each(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS,
                rows: int = ROWS) -> DataFrame:
    """The rows of ``documents``, all columns, that stand for their component;
    of rows that repeat a doc_id the one with the smallest text."""
    folder = run_folder(documents.sparkSession, "near-dedup-kept")
    found = classes(documents, width, percent, bands, rows)
    kept = written(found.groupBy("id").agg(F.min("component").alias("component")).where(F.col("id") == F.col("component"))
                   .select("id"), f"{folder}/kept")
    # the row travels as one column, so that no name of its columns can clash
    rows = documents.select(row_id().alias("id"), F.col("text").alias("order"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("order"))
    return rows.join(kept, "id", "left_semi").withColumn("k", first).where(F.col("k") == 1).select("row.*")
