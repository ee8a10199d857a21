"""The operators that SQL cannot express against plain loops."""
import hashlib
import math
import random

import numpy as np
import pyarrow as pa

from gridlab.llm import chunk_dedup, html_blocks, quality_nbsvm

from .conftest import prose


# ---- substring dedup
def plain_chunks(text):
    """Ends of the chunks of a text's lower-cased bytes, byte by byte."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    gear = [int(g) for g in chunk_dedup._GEAR]

    def roll(end):  # of the last 32 bytes before ``end``
        h = 0
        for b in data[max(0, end - 32):end]:
            h = (h * 2 + gear[b]) % 2**32
        return h

    def between(k):
        return k == len(data) or data[k] & 0xC0 != 0x80

    def smallest(at):
        ends = [k for k in range(at + chunk_dedup.MIN_CHUNK, at + chunk_dedup.MAX_CHUNK + 1) if between(k)]
        return min(ends, key=lambda k: (roll(k), k))

    ends, at = [], 0
    for c in range(1, len(data)):
        if c < 32 or c - at < chunk_dedup.MIN_CHUNK or not between(c) or roll(c) >> (32 - chunk_dedup.MASK_BITS):
            continue
        while c - at > chunk_dedup.MAX_CHUNK:
            at = smallest(at)
            ends.append(at)
        if c - at >= chunk_dedup.MIN_CHUNK:
            ends.append(c)
            at = c
    while len(data) - at > chunk_dedup.MAX_CHUNK:
        at = smallest(at)
        ends.append(at)
    if len(data) > at:
        ends.append(len(data))
    return data, ends


def plain_kept(docs):
    """(doc_id, passages, kept text): chunks that an earlier place holds, in
    runs of enough words or characters, are cut out."""
    chunks, first = {}, {}
    for doc, text in docs:
        data, ends = plain_chunks(text or "")
        chunks[doc] = [(a, b, hashlib.blake2b(data[a:b], digest_size=12).digest()) for a, b in zip([0, *ends], ends)]
        for pos, (_, _, d) in enumerate(chunks[doc]):
            first[d] = min(first.get(d, (doc, pos)), (doc, pos))
    out = set()
    for doc, text in docs:
        raw, own = (text or "").encode(), chunks[doc]
        copies = [first[d] != (doc, pos) for pos, (_, _, d) in enumerate(own)]
        kept, n, pos = b"", 0, 0
        while pos < len(own):
            end = pos
            while end < len(own) and copies[end]:
                end += 1
            if end > pos:
                a, b = own[pos][0], own[end - 1][1]
                starts = sum(1 for k in range(a, b) if raw[k:k + 1].strip(b" \t\n\x0b\x0c\r") and (k == 0 or not raw[k - 1:k].strip(b" \t\n\x0b\x0c\r")))
                if starts >= chunk_dedup.MIN_RUN_WORDS or len(raw[a:b].decode()) >= chunk_dedup.MIN_RUN_CHARS:
                    n += 1
                else:
                    kept += raw[a:b]
                pos = end
            else:
                kept += raw[own[pos][0]:own[pos][1]]
                pos += 1
        out.add((doc, n, kept.decode()))
    return out


def test_chunk_dedup_equals_plain_loops(spark):
    rng = random.Random(9)
    shared = [prose(rng, 80, 900) for _ in range(4)] + ["é日本語" * 60, "ab" * 400]
    docs = []
    for i in range(30):
        parts = [prose(rng, rng.randrange(0, 60), 900)]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), prose(rng, rng.randrange(5, 40), 900)]
        docs.append((i, (" " if i % 2 else "\n").join(parts)))
    docs += [(100, docs[3][1].upper()), (101, docs[4][1]), (102, ""), (103, None), (104, "short")]
    got = {(r["doc_id"], r["n_passages"], r["kept_text"]) for r in chunk_dedup.kept_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = plain_kept(docs)
    assert got == want and sum(n for _, n, _ in want) > 8


# ---- extraction
def test_the_labeller_equals_a_plain_recurrent_network():
    rng = np.random.RandomState(1)
    w = html_blocks.new_weights(6, 3)
    sizes = np.array([4, 1, 7])
    x = rng.randn(12, 6).astype(np.float32)
    got = html_blocks.logits(w, x, sizes)

    def sig(v):
        return 1 / (1 + math.exp(-v))

    want, at = [], 0
    for n in sizes:
        page = x[at:at + n]
        at += n
        states = {}
        for d, order in (("f", range(n)), ("b", range(n - 1, -1, -1))):
            h, c = [0.0] * 3, [0.0] * 3
            for t in order:
                a = [float(w["b" + d][j]) + sum(float(page[t][k]) * float(w["W" + d][k][j]) for k in range(6))
                     + sum(h[k] * float(w["U" + d][k][j]) for k in range(3)) for j in range(12)]
                c = [sig(a[3 + j]) * c[j] + sig(a[j]) * math.tanh(a[9 + j]) for j in range(3)]
                h = [sig(a[6 + j]) * math.tanh(c[j]) for j in range(3)]
                states[d, t] = h
        for t in range(n):
            both = states["f", t] + states["b", t]
            want.append(float(w["v"][0]) + sum(v * s for v, s in zip(map(float, w["V"]), both)))
    assert np.allclose(got, want, atol=1e-5)


# ---- quality classifier
def test_scores_follow_the_fitted_weights(spark):
    rng = random.Random(4)
    rows = [(i, ("a fine sentence of words " if i % 2 else "99 !! xx ## ") + prose(rng, 15)) for i in range(80)] + [(90, ""), (91, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    w, ratio, bias, slope, offset = quality_nbsvm.fit(docs, labels)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality_nbsvm.quality_scores(docs, labels).collect()}
    for doc, text in rows:
        on = np.flatnonzero(next(quality_nbsvm._indicators(pa.array([text or ""])))[1][0])
        norm = math.sqrt(sum(float(ratio[k]) ** 2 for k in on)) or 1.0
        margin = sum(float(w[k]) * float(ratio[k]) for k in on) / norm + bias
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * margin + offset))))
        assert abs(got[doc][0] - want) < 1e-4
        assert abs(want - quality_nbsvm.THRESHOLD) < 1e-4 or got[doc][1] == int(want >= quality_nbsvm.THRESHOLD)


def test_log_ratios_equal_counted_shares():
    rng = np.random.RandomState(2)
    rows = [np.unique(rng.randint(0, 50, 12)) for _ in range(30)]
    y = np.array([k % 2 for k in range(30)])
    got = quality_nbsvm.log_ratios(rows, y)
    counts = {c: np.full(quality_nbsvm.DIMS, quality_nbsvm.SMOOTHING) for c in (0, 1)}
    for r, c in zip(rows, y):
        for k in r:
            counts[int(c)][k] += 1
    want = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    assert np.allclose(got, want)
