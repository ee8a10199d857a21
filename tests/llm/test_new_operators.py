"""Fill-in-middle, SimHash trees and spelling groups against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gridlab.llm import fill_in_middle as fim
from gridlab.llm import simhash_trees as sim
from gridlab.llm import spelling_groups as spell

from .conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- fill-in-middle
def brute_form(key, text):
    text = text or ""
    h = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("units", [1, 2, 7, 1000])
def test_frames_are_seekable_and_outputs_restore(units):
    rng = random.Random(units)
    codec = fim.Codec(units)
    for key in range(250):
        text = "".join(rng.choice("abé日🎉<PSM>") for _ in range(rng.randrange(60)))
        stored = codec.pack((text,))
        assert stored.units == len(text) and "".join(stored.stream()) == text
        assert all(y - x == units for x, y in zip([0, *stored.ends], stored.ends[:-1]))
        a, b = sorted((rng.randrange(len(text) + 1), rng.randrange(len(text) + 1)))
        assert "".join(stored.stream(a, b)) == text[a:b]
        form, a, b = fim.plan(stored, 1, key)
        assert "".join(fim.output(stored, form, a, b)) == brute_form(key, text)[4]
        assert "".join(fim.restored(codec.pack(fim.output(stored, form, a, b)), form)) == text


def test_selection_opens_only_the_frames_it_needs():
    codec = fim.Codec(10)
    stored = codec.pack(("0123456789" * 50,))
    opened = []

    class Counting:
        def decompress(self, part):
            opened.append(part)
            return codec._open.decompress(part)

    stored._open = Counting()
    assert "".join(stored.stream(205, 221)) == ("0123456789" * 50)[205:221]
    assert len(opened) == 3 and len(stored.parts) == 50


def test_fill_in_middle_equals_brute_force(spark, edge_docs, no_docs, edge_rows):
    rows = fim.fill_in_middle(edge_docs).collect()
    want = Counter()
    for r in edge_rows:
        if r[0] is not None:
            n, form, a, m, out = brute_form(r[0], r[1])
            want[(r[0], n, form, a, m, sha(out), sha(r[1] or ""))] += 1
    assert Counter(tuple(r)[:7] for r in rows if r["doc_id"] is not None) == want
    assert sum(r["doc_id"] is None for r in rows) == sum(r[0] is None for r in edge_rows)
    codec = fim.Codec()
    assert all(sha("".join(codec.unpack(r["output_frames"], r["output_ends"]).stream())) == r["output_sha256"] for r in rows)
    assert fim.fill_in_middle(no_docs).count() == 0
    docs = spark.createDataFrame([(k, prose(random.Random(k), k % 90)) for k in range(400)], "doc_id long, text string")
    got = {tuple(r) for r in fim.fill_in_middle(docs, keep_output=False).collect()}
    assert got == {(k, *brute_form(k, t)[:4], sha(brute_form(k, t)[4]), sha(t)) for k, t in docs.collect()}
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_frames_keep_the_columns(edge_docs):
    stored = fim.frames(edge_docs.drop("key"), 100)
    assert set(edge_docs.columns) - {"key", "text"} <= set(stored.columns) and stored.count() == edge_docs.count()
    with pytest.raises(ValueError, match="key"):
        fim.frames(edge_docs)


# ---- SimHash
def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    parts = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_simhash(rows, radius=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius or rows[i][0] == rows[j][0]:
                label[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return Counter((doc, f"{fps[i]:016x}", least[root(i)]) for i, (doc, _) in enumerate(rows))


def near_rows(seed, bases, copies):
    rng = random.Random(seed)
    rows = []
    for _ in range(bases):
        words = prose(rng, 80, 10**6).split()
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"o{rng.randrange(50)}"
            rows.append((len(rows) + 3, " ".join(own)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tree_size", [4096, 5])
def test_simhash_equals_brute_force(spark, tree_size):
    rows = near_rows(5, 25, 12) + [(900, ""), (901, " \n"), (902, None), (903, "A b"), (904, "a B"), (905, "x"), (906, "x y z w"), (906, "other text here now")]
    found = sim.simhash_classes(spark.createDataFrame(rows, "doc_id long, text string"), tree_size=tree_size)
    got = Counter((r["id"], f"{r['fp'] & (2**64 - 1):016x}", r["component"]) for r in found.collect())
    want = brute_simhash(rows)
    assert got == want
    assert 25 < len({c for _, _, c in want}) < 300


def test_simhash_query_form(spark, edge_docs, no_docs, edge_rows):
    rows = sim.simhash_duplicates(edge_docs).collect()
    assert Counter(r["fingerprint"] for r in rows) == Counter(f"{brute_fingerprint(r[1]):016x}" for r in edge_rows)
    own = [(r["doc_id"], r["component_id"]) for r in rows]
    assert (5, 4) in own and (2, 1) in own and (3, 1) in own and (None, 1) in own
    assert sim.simhash_duplicates(no_docs).count() == 0


def test_forest_finds_all_within_the_radius():
    rng = np.random.RandomState(2)
    x = np.repeat(rng.randint(0, 2**63 - 1, 100, dtype=np.int64).astype(np.uint64) * np.uint64(2), 8)
    for _ in range(5):
        x = x ^ (np.uint64(1) << rng.randint(0, 64, len(x)).astype(np.uint64))
    shard = (x % np.uint64(3)).astype(np.int64)
    query, node = sim.Forest(x, shard).search(x, shard, 4)
    near = (np.bitwise_count(x[:, None] ^ x[None, :]) <= 4) & (shard[:, None] == shard[None, :])
    assert Counter(zip(query.tolist(), node.tolist())) == Counter((int(i), int(j)) for i, j in zip(*np.nonzero(near)))


def test_fingerprints_within_the_radius_share_a_shard(spark):
    rng = random.Random(1)
    rows = []
    for k in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        rows.append((k, *(x - 2**64 if x >= 2**63 else x for x in (a, b))))
    from pyspark.sql import functions as F
    both = spark.createDataFrame(rows, "k long, a long, b long").select(
        F.arrays_overlap(sim.shard_keys(F.col("a"), 6, 4), sim.shard_keys(F.col("b"), 6, 4)).alias("same"))
    assert all(r["same"] for r in both.collect())


# ---- spelling
def brute_words(rows):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def brute_groups(rows):
    n = brute_words(rows)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    found = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and near(w, v)] for w in n}
    form = {}
    for w, own in found.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(found[w]), n[form[w]] if form[w] else None))
    return out


def misspelt(seed, texts):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(7, 11))) for _ in range(60)]
    rows = []
    for k in range(texts):
        words = []
        for _ in range(60):
            w = stock[min(rng.randrange(60), rng.randrange(60), rng.randrange(60))]
            if rng.random() < 0.08:
                i = rng.randrange(len(w))
                w = rng.choice((w[:i] + w[i + 1:], w[:i] + rng.choice("abcdeéÉ") + w[i:], w[:i] + rng.choice("abcdeé") + w[i + 1:]))
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((k, rng.choice((" ", "-", "\n")).join(words)))
    return rows


@pytest.mark.parametrize("depth, trie_size", [(3, 32_768), (1, 40), (2, 7)])
def test_spelling_groups_equal_brute_force(spark, depth, trie_size):
    rows = misspelt(depth, 120)
    got = spell.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"), depth=depth, trie_size=trie_size)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_groups(rows)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert any(r[2] not in (r[0], r[1]) for r in want) or sum(r[1] is not None for r in want) > 20


def test_roots_follow_forms_to_the_last(spark, tmp_path):
    chain = [(f"w{k:02d}", f"w{k + 1:02d}") for k in range(11)] + [("v", "w05")]
    ends = spell.roots(spark.createDataFrame(chain, "word string, form string"), str(tmp_path))
    assert {tuple(r) for r in ends.collect()} == {(w, "w11") for w, _ in chain}


def test_spelling_edges(spark, edge_docs, no_docs, edge_rows):
    rows = [(r[0], r[1]) for r in edge_rows if r[0] is not None] + [(50, "y" * 30_000 + " " + "y" * 29_999)] * 3
    extra = spark.createDataFrame([(50, "y" * 30_000 + " " + "y" * 29_999)] * 3, "doc_id long, text string")
    docs = edge_docs.where("doc_id IS NOT NULL").select("doc_id", "text").union(extra)
    assert {tuple(r) for r in spell.spelling_groups(docs).collect()} == brute_groups(rows)
    assert spell.spelling_groups(edge_docs).count() >= 0
    assert spell.spelling_groups(no_docs).count() == 0


def test_one_apart_by_letters():
    words = ["abcdefg", "abcdeg", "abcdefh", "bacdefg", "aabcdefg", "abcdefgg", "zabcdefgz", "abcdefg"]
    w = spell.Words(pa.array(words))
    got = spell.one_apart(w, np.zeros(len(words), np.int64), np.arange(len(words)))
    assert got.tolist() == [False, True, True, False, True, True, False, False]
