"""Fill-in-middle transformation over seekable compressed texts.

A text is stored as independent zstandard frames of at most ``frame_units``
code points, with the cumulative number of code points at the end of each
frame. To take the units [a, b) of a text, only frames that hold some of them
are decompressed, one at a time, and only the frames at the two cuts are cut.
A text's cuts are drawn from a hash of the seed and its key, so they depend on
nothing but the row. The output is stored the same way: its parts are streamed
from the text's frames into new ones. Digests are taken over the ordered
frames, and the text is restored from the output alone, by finding the markers
in its stream and taking the parts in their old order. So no text, output or
part is ever held decompressed as a whole beside its row.

Forms: ``plain`` (the text itself), ``psm`` (<P>prefix<S>suffix<M>middle) and
``spm`` (<S>suffix<P>prefix<M>middle). A text that is empty or holds a marker
stays plain, so that every output has one reading.

Defined cases: a null text is an empty one; rows that repeat a doc_id are cut
by the same draws, each in its own text; rows without a doc_id are keyed by
their text; very long texts are only more frames; an empty table gives an
empty one. ``frames`` keeps all columns of its input and refuses input that
already has one of its own; ``transformed`` reads only its own.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import row_id, run_folder, written
from .textops import give_back

SEED = 1
FRAME_UNITS = 1 << 14
PLAIN_PERCENT = 10
SPM_PERCENT = 20
MARKERS = ("<P>", "<S>", "<M>")
LEVEL = 1


class Frames:
    """A seekable text: ``parts``, one zstandard frame of UTF-8 each, and
    ``ends``, the code points up to the end of each."""

    def __init__(self, parts: list[bytes], ends: list[int], tool):
        self.parts, self.ends, self._open = parts, ends, tool

    @property
    def units(self) -> int:
        return self.ends[-1] if self.ends else 0

    def stream(self, a: int = 0, b: int | None = None) -> Iterator[str]:
        """The units [a, b) in order, a frame's share at a time."""
        b = self.units if b is None else b
        at = int(np.searchsorted(self.ends, a, "right"))
        while a < b:
            first = self.ends[at - 1] if at else 0
            text = self._open.decompress(self.parts[at]).decode()
            yield text if a == first and b >= self.ends[at] else text[a - first:b - first]
            a, at = self.ends[at], at + 1


class Codec:
    """Compressor and decompressor of a task."""

    def __init__(self, frame_units: int = FRAME_UNITS, level: int = LEVEL):
        import zstandard

        self.frame_units = frame_units
        self._close, self._open = zstandard.ZstdCompressor(level=level), zstandard.ZstdDecompressor()

    def pack(self, stream: Iterable[str]) -> Frames:
        """Frames of a streamed text; all but the last hold ``frame_units``."""
        parts, ends, held, size = [], [0], [], 0
        for text in stream:
            while text:
                piece = text[:self.frame_units - size]
                text = text[len(piece):]
                held.append(piece)
                size += len(piece)
                if size == self.frame_units:
                    parts.append(self._close.compress("".join(held).encode()))
                    ends.append(ends[-1] + size)
                    held, size = [], 0
        if size:
            parts.append(self._close.compress("".join(held).encode()))
            ends.append(ends[-1] + size)
        return Frames(parts, ends[1:], self._open)

    def unpack(self, parts: list[bytes], ends: list[int]) -> Frames:
        return Frames(parts, ends, self._open)


def find(stream: Iterable[str], marker: str, start: int = 0) -> int:
    """The unit at which ``marker`` first begins, -1 if it doesn't; counted
    from ``start`` at the stream's first unit."""
    tail, at = "", start
    for text in stream:
        both = tail + text
        k = both.find(marker)
        if k >= 0:
            return at - len(tail) + k
        at += len(text)
        tail = both[max(0, len(both) - len(marker) + 1):]
    return -1


def holds(stream: Iterable[str], markers: Iterable[str]) -> bool:
    """Whether a streamed text holds one of the markers."""
    tail, keep = "", max(map(len, markers)) - 1
    for text in stream:
        both = tail + text
        if any(m in both for m in markers):
            return True
        tail = both[-keep:]
    return False


def draws(seed: int, key: int) -> tuple[int, int, int, int]:
    """h1 to h4: the first four 32-bit numbers of sha256 of ``seed:key``."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(h[k:k + 4], "big") for k in range(0, 16, 4))


def plan(text: Frames, seed: int, key: int, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT,
         markers: tuple[str, str, str] = MARKERS) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle)."""
    n = text.units
    h1, h2, h3, h4 = draws(seed, key)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or h3 % 100 >= 100 - plain_percent or holds(text.stream(), markers):
        return "plain", a, b
    return ("spm" if h4 % 100 < spm_percent else "psm"), a, b


def output(text: Frames, form: str, a: int, b: int, markers: tuple[str, str, str] = MARKERS) -> Iterator[str]:
    """The transformed text, streamed."""
    if form == "plain":
        yield from text.stream()
        return
    prefix, suffix, middle = (0, a), (b, text.units), (a, b)
    p, s, m = markers
    for marker, part in ((p, prefix), (s, suffix), (m, middle)) if form == "psm" else ((s, suffix), (p, prefix), (m, middle)):
        yield marker
        yield from text.stream(*part)


def restored(out: Frames, form: str, markers: tuple[str, str, str] = MARKERS) -> Iterator[str]:
    """The text that an output was made of, from the output and its form."""
    if form == "plain":
        yield from out.stream()
        return
    first, second = (markers[0], markers[1]) if form == "psm" else (markers[1], markers[0])
    one = len(first)
    end_one = find(out.stream(one), second, one)
    two = end_one + len(second)
    end_two = find(out.stream(two), markers[2], two)
    parts = [(one, end_one), (two, end_two)]
    prefix, suffix = parts if form == "psm" else parts[::-1]
    yield from out.stream(*prefix)
    yield from out.stream(end_two + len(markers[2]))
    yield from out.stream(*suffix)


def digest(stream: Iterable[str]) -> str:
    h = hashlib.sha256()
    for text in stream:
        h.update(text.encode())
    return h.hexdigest()


_OWN = (("key", "long"), ("frames", "array<binary>"), ("unit_ends", "array<long>"))


def frames(documents: DataFrame, frame_units: int = FRAME_UNITS) -> DataFrame:
    """All columns of ``documents`` but text, and key (what draws are hashed
    from), frames and unit_ends."""
    clash = {c.lower() for c in documents.columns} & {c for c, _ in _OWN}
    if clash:
        raise ValueError(f"columns of the operator's own: {sorted(clash)}")
    rest = [c for c in documents.columns if c.lower() != "text"]
    rows = documents.select(*[F.col(f"`{c}`") for c in rest], row_id().alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = StructType([*rows.drop("text").schema, StructField("frames", ArrayType(BinaryType())), StructField("unit_ends", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(frame_units)
        for batch in batches:
            made = [codec.pack((t.as_py(),)) for t in batch.column("text")]
            own = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array([m.parts for m in made], pa.list_(pa.binary())), pa.array([m.ends for m in made], pa.list_(pa.int64()))],
                [*own.schema.names, "frames", "unit_ends"])
        give_back()

    return rows.mapInArrow(run, schema)


def transformed(stored: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT,
                frame_units: int = FRAME_UNITS, keep_output: bool = True) -> DataFrame:
    """One row per row of ``stored`` (as ``frames`` gives it): doc_id, n (code
    points), form, prefix_chars and middle_chars (null if plain), output_sha256,
    restored_sha256 and, with ``keep_output``, output_frames and output_ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(frame_units)
        for batch in batches:
            rows = []
            for key, parts, ends in zip(batch.column("key").to_pylist(), batch.column("frames"), batch.column("unit_ends")):
                text = codec.unpack(parts.as_py(), ends.as_py())
                form, a, b = plan(text, seed, key, plain_percent, spm_percent)
                out = codec.pack(output(text, form, a, b))
                cuts = (None, None) if form == "plain" else (a, b - a)
                rows.append((text.units, form, *cuts, digest(out.stream()), digest(restored(out, form)), out.parts, out.ends))
            columns = list(zip(*rows)) or [()] * 8
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            names = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output_frames", "output_ends")
            keep = len(names) if keep_output else 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns[:keep], kinds)]],
                                             ["doc_id", *names[:keep]])
        give_back()

    schema = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
              + (", output_frames array<binary>, output_ends array<long>" if keep_output else ""))
    return stored.select(F.col("doc_id").cast("long").alias("doc_id"), "key", "frames", "unit_ends").mapInArrow(run, schema)


def fill_in_middle(documents: DataFrame, seed: int = SEED, keep_output: bool = True) -> DataFrame:
    """``transformed`` of ``documents``, whose frames are written to the shared
    folder first: a lost task reads its frames again."""
    folder = run_folder(documents.sparkSession, "fill-in-middle")
    return transformed(written(frames(documents.select("doc_id", "text")), f"{folder}/frames"), seed, keep_output=keep_output)
