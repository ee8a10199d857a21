"""Sampled segmentation into SentencePiece pieces, and lossless decoding.

A text becomes bytes with one blank in front (blanks are the pieces' word
mark). Its lattice has an edge for every piece that matches at a position, and
byte edges for characters that have no piece of their own, so that every text,
the word mark's own character included, has a path and decodes to itself.

Forward filtering gives each position the log of the summed weights of all
paths to it; backward sampling then walks from the end to the start and draws
each edge by its share of that sum. So whole segmentations are drawn from the
lattice's exact distribution, the product of piece weights. Draws are numbers
hashed from the seed, the row's key, the chunk's place in the text and the
step, so they depend on nothing else: not on batches, partitions or retries.

No piece reaches over a blank that follows another character, nor over a
character that no piece contains; between such places the lattice falls apart
into independent chunks. Equal chunks of a block share their forward pass, and
the passes and walks of all chunks run in step as array operations. Work is
linear in the text's length; memory is bounded by ``BLOCK`` bytes of text and
by the longest chunk, as a longer text is drawn in slices of chunks.

The vocabulary is a given public model that is read, never trained; only its
pieces and ranks (some 32,000) and their trie (under 8 MB) are broadcast. A model of merge ranks has no
probabilities: the weight of a piece is 1 / (rank + ``RANK_OFFSET``), to the
power ``sharpness``.

Defined cases: null and empty texts have no pieces and decode to the empty
text; equal rows get equal segmentations; rows without a doc_id are keyed by
their text.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_id
from .textops import give_back, mix64, span_hashes, text_blocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 17
SHARPNESS = 1.0
RANK_OFFSET = 10.0
BLOCK = 1 << 17
_MARK = "▁"
_BLANK = 0x20
_U = np.uint64


class Vocabulary(NamedTuple):
    """What the lattice needs of a model. ``pieces``: bytes of each id with
    blanks for the word mark, None for control pieces."""
    pieces: list
    weights: np.ndarray  # log weight of each id
    byte_ids: np.ndarray  # id of each byte's own piece


def read_vocabulary(path: str = MODEL, sharpness: float = SHARPNESS) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: list = []
    byte_ids = np.full(256, -1, np.int64)
    weights = np.zeros(model.get_piece_size())
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        rank = float(-model.get_score(i))
        if model.is_byte(i):
            byte_ids[int(text[1:-1], 16)] = i
            pieces.append(bytes([int(text[1:-1], 16)]))
            rank = float(model.get_piece_size())
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            pieces.append(None)
        else:
            pieces.append(text.replace(_MARK, " ").encode())
        weights[i] = -sharpness * np.log(max(rank, 0.0) + RANK_OFFSET)
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces, so not every text can be encoded")
    return Vocabulary(pieces, weights, byte_ids)


class Lattice:
    """Tables of a vocabulary: a trie over bytes, which characters have a
    piece of their own, and which are part of any piece."""

    def __init__(self, v: Vocabulary):
        self.weights, self.byte_ids = v.weights, v.byte_ids
        is_byte = np.zeros(len(v.pieces), bool)
        is_byte[v.byte_ids] = True
        kept: list[tuple[bytes, int]] = []
        self.own = np.zeros(0x110000, bool)
        self.part = np.zeros(0x110000, bool)
        self.longest = 1
        for i, piece in enumerate(v.pieces):
            if piece is None or is_byte[i] or not piece or b" " in piece.lstrip(b" "):
                continue  # the last: a blank after another character, where chunks are cut
            chars = piece.decode()
            self.part[[ord(c) for c in chars]] = True
            if len(chars) == 1:
                self.own[ord(chars)] = True
            kept.append((piece, i))
            self.longest = max(self.longest, len(piece))
        self.alone = np.append(~self.part, False)  # in no piece; the last for -1, inside a character
        self._trie(sorted(kept))
        sizes = np.array([len(p) if p else 0 for p in v.pieces])
        self.piece_at = np.concatenate(([0], np.cumsum(sizes)))
        self.piece_bytes = np.frombuffer(b"".join(p or b"" for p in v.pieces), np.uint8)

    def _trie(self, pieces: list[tuple[bytes, int]]) -> None:
        """The pieces' prefixes as nodes, 0 the root. The children of a node
        lie in one table of all nodes: ``child[base[node] + byte]`` is theirs
        where ``parent`` of that place is the node. Rows of children are laid
        into each other's gaps, so the table has few more places than nodes."""
        children: list[tuple[int, bytes, list[int]]] = []
        ends = [-1]
        todo = [(0, 0, 0, len(pieces))]  # node, depth, range of the pieces below
        while todo:
            node, depth, lo, hi = todo.pop()
            if len(pieces[lo][0]) == depth:
                ends[node] = pieces[lo][1]
                lo += 1
            letters, below = [], []
            while lo < hi:
                letter, first = pieces[lo][0][depth], lo
                while lo < hi and pieces[lo][0][depth] == letter:
                    lo += 1
                letters.append(letter)
                below.append(len(ends))
                todo.append((len(ends), depth + 1, first, lo))
                ends.append(-1)
            if letters:
                children.append((node, bytes(letters), below))
        room = len(ends) + 1024
        parent = np.full(room, -1, np.int32)
        child = np.zeros(room, np.int32)
        base = np.zeros(len(ends), np.int32)
        free = bytearray(b"\x01") * room
        lowest, wide = 256, 257  # bases stay at 0 or more
        children.sort(key=lambda c: -len(c[1]))
        for node, letters, below in children:
            if len(letters) == 1 < wide:  # the gaps are filled by single children
                lowest = 256
            wide = len(letters)
            lowest = at = free.index(1, lowest)
            while True:
                start = at - letters[0]
                if start + letters[-1] >= len(free):
                    free.extend(b"\x01" * room)
                    parent, child = (np.concatenate((x, np.full(room, fill, np.int32))) for x, fill in ((parent, -1), (child, 0)))
                if all(free[start + b] for b in letters):
                    break
                lowest = at = free.index(1, at + 1)
            base[node] = start
            for b, to in zip(letters, below):
                free[start + b] = 0
                parent[start + b], child[start + b] = node, to
        size = int(base.max()) + 256
        pad = max(size - len(parent), 0)
        self.base, self.ends = base, np.array(ends, np.int32)
        self.parent = np.concatenate((parent, np.full(pad, -1, np.int32)))[:size]
        self.child = np.concatenate((child, np.zeros(pad, np.int32)))[:size]

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node along a byte; 0 if it has none."""
        at = self.base[node] + byte
        return np.where(self.parent[at] == node, self.child[at], 0)

    def characters(self, data: np.ndarray) -> np.ndarray:
        """The code point that starts at each byte, -1 inside a character.
        Characters are not cut off: data holds whole texts."""
        out = data.astype(np.int32)
        at = np.flatnonzero(data >= 0x80)
        if len(at):
            b = np.concatenate((data, np.zeros(3, np.uint8)))
            b0, b1, b2, b3 = (b[at + k].astype(np.int32) for k in range(4))
            b1, b2, b3 = b1 & 63, b2 & 63, b3 & 63
            code = np.where(b0 < 0xC0, -1, (b0 & 31) << 6 | b1)
            code = np.where(b0 >= 0xE0, (b0 & 15) << 12 | b1 << 6 | b2, code)
            out[at] = np.where(b0 >= 0xF0, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3, code)
        return out

    def edges(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all lattice edges; stop: where the chunk of
        each byte ends."""
        starts, ends, pieces = [], [], []
        at = np.arange(len(data), dtype=np.int32)
        node = np.zeros(len(data), np.int32)
        for size in range(1, self.longest + 1):
            node = self.step(node, data[at + size - 1])
            alive = node > 0
            at, node = at[alive], node[alive]
            piece = self.ends[node]
            hit = piece >= 0
            starts.append(at[hit])
            ends.append(at[hit] + size)
            pieces.append(piece[hit])
            more = at + size < stop[at]
            at, node = at[more], node[more]
            if not len(at):
                break
        chars = self.characters(data)
        lone = np.zeros(len(data), bool)  # bytes of characters without a piece
        first = np.flatnonzero(chars >= 0)
        missing = first[~self.own[chars[first]] | (chars[first] == ord(_MARK))]
        lone[missing] = True
        for k in range(1, 4):
            tail = missing[missing + k < len(data)] + k
            tail = tail[(data[tail] & 0xC0) == 0x80]
            lone[tail[lone[tail - 1]]] = True
        at = np.flatnonzero(lone)
        starts.append(at)
        ends.append(at + 1)
        pieces.append(self.byte_ids[data[at]])
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(pieces)


def _with_blank(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A blank in front of every text that is not empty."""
    full = np.diff(off) > 0
    return np.insert(data, off[:-1][full], _BLANK), off + np.concatenate(([0], np.cumsum(full)))


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. (size[0] numbers), first[1], .."""
    before = np.concatenate(([0], np.cumsum(size)[:-1]))
    return np.arange(int(size.sum())) + np.repeat(first - before, size)


def sample_block(lattice: Lattice, data: np.ndarray, off: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of all texts, number of each text's pieces). keys: a 64-bit
    number of each text that its draws are hashed from. A text beyond ``BLOCK``
    bytes stands alone and is drawn in slices between chunks, which gives the
    same pieces in bounded memory."""
    data, off = _with_blank(data, off)
    if len(off) > 2 or len(data) <= 2 * BLOCK:
        return _sample(lattice, data, off, keys, 0)[:2]
    blank = data == _BLANK
    borders = np.append(np.flatnonzero(blank[1:] & ~blank[:-1]) + 1, len(data))
    del blank
    out, lo, place = [], 0, 0
    while lo < len(data):
        hi = int(borders[min(np.searchsorted(borders, lo + BLOCK), len(borders) - 1)])
        ids, _, chunks = _sample(lattice, data[lo:hi], np.array([0, hi - lo]), keys, place)
        out.append(ids)
        lo, place = hi, place + chunks
    ids = np.concatenate(out)
    return ids, np.array([len(ids)])


def _sample(lattice: Lattice, data: np.ndarray, off: np.ndarray, keys: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray, int]:
    """sample_block of texts with their blank in front, and the number of
    chunks; ``before``: chunks of the text before the slice that is given."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64), 0
    chars = lattice.characters(data)
    blank = data == _BLANK
    cut = np.zeros(len(data), bool)
    cut[1:] = blank[1:] & ~blank[:-1]
    single = np.flatnonzero(lattice.alone[chars])
    cut[single] = True
    behind = single + 1 + (data[single] >= 0xC0) + (data[single] >= 0xE0) + (data[single] >= 0xF0)
    cut[behind[behind < len(data)]] = True
    cut[off[:-1][off[:-1] < len(data)]] = True
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(data))
    first_chunk = np.searchsorted(begin, off)  # of each text
    text = np.repeat(np.arange(len(off) - 1), np.diff(first_chunk))
    place = np.arange(len(begin)) - first_chunk[text] + before
    del chars, blank, cut, single, behind

    _, sample, chunk = np.unique(span_hashes(data, begin, end), return_index=True, return_inverse=True)
    size = end[sample] - begin[sample]
    head = np.concatenate(([0], np.cumsum(size)))  # of each distinct chunk, in the bytes of all of them
    own = data[_ranges(begin[sample], size)]
    stop = np.repeat(head[1:], size)
    # nodes: one more than bytes in each chunk; node of byte x of chunk c is x + c
    number = np.repeat(np.arange(len(size)), size)
    start, finish, piece = lattice.edges(own, stop)
    c = number[start]
    a, b = start + c, finish + c
    depth = finish - head[c]
    order = np.argsort(depth * (int(head[-1]) + len(size) + 1) + b)
    a, b, piece, depth = a[order], b[order], piece[order], depth[order]
    weight = lattice.weights[piece]
    forward = np.full(int(head[-1]) + len(size), -np.inf)
    forward[head[:-1] + np.arange(len(size))] = 0.0
    share = np.empty(len(a))
    node_first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    levels = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2))
    for lo, hi in zip(levels[:-1], levels[1:]):  # all positions of the same depth in their chunks at once
        if lo == hi:
            continue
        value = forward[a[lo:hi]] + weight[lo:hi]
        heads = node_first[np.searchsorted(node_first, lo):np.searchsorted(node_first, hi)] - lo
        runs = np.diff(np.append(heads, hi - lo))
        top = np.maximum.reduceat(value, heads)
        safe = np.where(np.isfinite(top), top, 0.0)
        scaled = np.exp(value - np.repeat(safe, runs))
        total = np.add.reduceat(scaled, heads)
        with np.errstate(divide="ignore"):
            forward[b[lo:hi][heads]] = safe + np.log(total)
        share[lo:hi] = scaled / np.repeat(np.where(total > 0, total, 1.0), runs)
    # edges by end node, the likeliest first, with the running sum of shares
    back = np.argsort(b - 0.5 * share)
    a, b, piece, share = a[back].astype(np.int32), b[back], piece[back].astype(np.int32), share[back]
    heads = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    runs = np.diff(np.append(heads, len(b)))
    sums = np.cumsum(share)
    level = sums - np.repeat(sums[heads] - share[heads], runs)
    first_edge = np.zeros(len(forward), np.int32)
    first_edge[b[heads]] = heads
    last_edge = np.zeros(len(forward), np.int32)  # the last with a share: rounding never leads to one without
    last_edge[b[heads]] = heads + np.maximum.reduceat(np.where(share > 0, np.arange(len(b)) - np.repeat(heads, runs), 0), heads)

    draw = mix64(keys[text] + mix64(place.astype(np.uint64) + _U(1)))
    at = head[1:][chunk] + chunk  # each chunk's last node
    first = head[:-1][chunk] + chunk
    active = np.arange(len(begin))
    steps, taken = [], []
    step = 0
    while len(active):
        u = (mix64(draw[active] + _U((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) >> _U(11)).astype(np.float64) * 2.0**-53
        node = at[active]
        edge = first_edge[node]
        rim = last_edge[node]
        late = np.flatnonzero((level[edge] <= u) & (edge < rim))
        while len(late):
            edge[late] += 1
            late = late[(level[edge[late]] <= u[late]) & (edge[late] < rim[late])]
        steps.append(active)
        taken.append(piece[edge])
        at[active] = a[edge]
        active = active[at[active] > first[active]]
        step += 1
    counts = np.zeros(len(begin), np.int64)
    for done in steps:
        counts[done] += 1
    last = np.cumsum(counts) - 1
    out = np.empty(int(counts.sum()), np.int32)
    for k, (done, pieces) in enumerate(zip(steps, taken)):
        out[last[done] - k] = pieces
    return out, np.bincount(text, weights=counts, minlength=len(off) - 1).astype(np.int64), len(begin)


def decode_block(lattice: Lattice, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts that the pieces spell, without the blank
    in front."""
    size = lattice.piece_at[ids + 1] - lattice.piece_at[ids]
    data = lattice.piece_bytes[_ranges(lattice.piece_at[ids], size)]
    ends = np.concatenate(([0], np.cumsum(size)))
    off = ends[np.concatenate(([0], np.cumsum(counts)))]
    full = np.diff(off) > 0
    keep = np.ones(len(data), bool)
    keep[off[:-1][full]] = False
    return data[keep], off - np.concatenate(([0], np.cumsum(full)))


def row_keys(ids: np.ndarray, seed: int) -> np.ndarray:
    return mix64(ids.view(np.uint64) ^ mix64(np.array([seed & 0xFFFFFFFFFFFFFFFF], np.uint64)))


def sampled_pieces(documents: DataFrame, seed: int = SEED, path: str = MODEL, sharpness: float = SHARPNESS,
                   keep_pieces: bool = True) -> DataFrame:
    """One row per document: doc_id, n_pieces, pieces_sha256 (of the ids as
    little-endian 32-bit integers), lossless (the pieces decode to the text)
    and, with ``keep_pieces``, pieces."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(Lattice(read_vocabulary(path, sharpness)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared.value
        for batch in batches:
            row = batch.column("row").to_numpy()
            for first, data, off in text_blocks(batch.column("text"), BLOCK):
                n = len(off) - 1
                ids, counts = sample_block(lattice, data, off, row_keys(row[first:first + n], seed))
                again, again_off = decode_block(lattice, ids, counts)
                ends = np.concatenate(([0], np.cumsum(counts)))
                raw = ids.astype("<i4")
                digests = [hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(ends, ends[1:])]
                same = again_off[1:] - again_off[:-1] == np.diff(off)
                if same.all() and np.array_equal(again, data):
                    lossless = same
                else:
                    lossless = np.array([again[again_off[i]:again_off[i + 1]].tobytes() == data[off[i]:off[i + 1]].tobytes() for i in range(n)])
                columns = [batch.column("doc_id").slice(first, n), pa.array(counts), pa.array(digests, pa.string()), pa.array(lossless)]
                names = ["doc_id", "n_pieces", "pieces_sha256", "lossless"]
                if keep_pieces:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)))
                    names.append("pieces")
                yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    schema = "doc_id long, n_pieces long, pieces_sha256 string, lossless boolean" + (", pieces array<int>" if keep_pieces else "")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_id().alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


def decoder(spark: SparkSession, path: str = MODEL):
    """A column function from pieces (array<int>) to text; null has none."""
    shared = spark.sparkContext.broadcast(Lattice(read_vocabulary(path)))

    @F.arrow_udf("string")
    def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lattice = shared.value
        for lists in parts:
            counts = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            data, off = decode_block(lattice, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            raw = data.tobytes()
            yield pa.array([raw[a:b].decode() for a, b in zip(off, off[1:])], pa.string())
    return decode
