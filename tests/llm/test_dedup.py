"""Near-dedup and chunk dedup against brute force."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np

from gridlab.llm import chunk_dedup, near_dedup, queries
from gridlab.llm.textops import LOWER

from .conftest import prose

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k:k + width]) for k in range(len(words) - width + 1))


def brute_components(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        seen = Counter(j for g in s for j in holders[g])
        for j, both in seen.items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                a, b = find(sets[j][0]), find(sets[k][0])
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(k)
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(seed, bases=8, copies=40):
    """Chains and clouds of near copies around the limit, and plain texts."""
    rng = random.Random(seed)
    rows = []
    for _ in range(bases):
        base = prose(rng, rng.randrange(30, 200)).split()
        cur = base
        for k in range(copies):
            cur = list(cur if k % 3 else base)
            cur = cur[:len(cur) - rng.choice((0, 0, len(cur) // 12, len(cur) // 7))] + [f"more{rng.randrange(10**6)}" for _ in range(rng.choice((0, 0, len(base) // 12)))]
            for _ in range(rng.randrange(0, max(2, len(cur) // 40))):
                cur[rng.randrange(len(cur))] = f"new{rng.randrange(10**6)}"
            rows.append(rng.choice((str.upper, str.lower, str.title))(" ".join(cur)).replace(" ", rng.choice((" ", "\n", "  "))))
    rows += [prose(rng, rng.randrange(0, 60), 10**6) for _ in range(200)] + ["", " ", "one two", "one two", "ONE  two"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_dedup_equals_brute_force(spark):
    for seed in (1, 2):
        rows = near_copies(seed)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
               near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == brute_components(rows)


def test_many_copies_of_one_text_make_no_pairs(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "'the same words in every one of these documents again' as text")
    got = near_dedup.near_duplicates(docs)
    assert got.where("component_id = 0").count() == 5000 and got.where("kept").count() == 1


def test_texts_alike_but_not_enough_need_more_hubs(spark):
    """Half of every text is common, so buckets hold classes of many
    components, more than the first hubs settle; some are linked among
    themselves, but not with the hubs."""
    rng = random.Random(5)
    common = [f"c{k}" for k in range(120)]
    rows = []
    for k in range(60):
        own = [f"o{k}_{j}" for j in range(30)]
        rows.append((2 * k, " ".join(common + own)))
        own[rng.randrange(30)] = "changed"
        rows.append((2 * k + 1, " ".join(common + own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components(rows)
    assert got == want and len({c for _, c in want.values()}) == 60


def test_a_link_is_found_when_the_first_component_changes(spark):
    """x and y meet at words that over 300 classes have. In the first round x
    is the first component there; then y is linked with a smaller id
    elsewhere. The guards keep both links from being found by the bands."""
    rng = random.Random(2)
    new = lambda n: [f"u{rng.randrange(10**12)}" for _ in range(n)]
    s, t = new(4), new(4)
    rows = [s + t + new(37) for _ in range(100)] + [t + new(6), s + new(6)]
    low, x, y = 100, 101, 502
    rows += [[w for j, w in enumerate(s) if j != k % 4] + new(7) for k in range(400)] + [s + t + new(2)]
    docs = list(enumerate(" ".join(words) for words in rows))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(
        spark.createDataFrame(docs, "doc_id long, text string"), width=1, percent=20, bands=6, rows=1).collect()}
    assert got[y] == got[x] == low
    assert len(set(got.values())) == len(rows) - 2


def test_signature_is_circulant():
    s = np.random.RandomState(0).randint(0, 2**62, 500).astype(np.uint64)
    sig = near_dedup.circulant_signature(s, 125)
    base = (near_dedup.mix64(s ^ near_dedup._SIGMA) >> np.uint64(32)).astype(np.uint32)
    for k in (0, 1, 124):
        assert sig[k] == near_dedup._mix32((base + np.uint32(k)).astype(np.uint32)).min()
    other = np.concatenate((s[:450], np.random.RandomState(1).randint(0, 2**62, 50).astype(np.uint64)))
    sigs = [near_dedup.circulant_signature(x, 2000) for x in (s, other)]
    assert abs((sigs[0] == sigs[1]).mean() - 450 / 550) < 0.05


def test_near_dedup_edges(edge_docs, no_docs, edge_rows):
    got = near_dedup.near_duplicates(edge_docs).collect()
    assert len(got) == len(edge_rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["component_id"] == 4 and not r["kept"] for r in by[5]) and by[4][0]["kept"]
    assert all(r["n_shingles"] == 0 and r["kept"] for i in (1, 2, 3) for r in by[i])
    assert near_dedup.near_duplicates(no_docs).count() == 0
    one = near_dedup.one_of_each(edge_docs)
    assert one.columns == edge_docs.columns
    kept = [r["doc_id"] for r in one.collect()]
    assert sorted(x for x in kept if x is not None) == [-7, 1, 2, 3, 4, 6, 8] and kept.count(None) == 1  # its other text is linked with 6
    assert near_dedup.one_of_each(no_docs).count() == 0


def test_gear_hash_rolls():
    data = np.frombuffer(bytes(random.Random(3).randrange(256) for _ in range(500)), np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(chunk_dedup._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert chunk_dedup.gear_hashes(data).tolist() == want


def test_chunks_cover_the_text_and_survive_insertions():
    rng = random.Random(6)
    text = prose(rng, 3000, 10**5)
    cut = lambda t: [t.encode()[a:b] for a, b in
                     (lambda e: zip([0, *e[:-1]], e))(chunk_dedup.chunk_ends(LOWER[np.frombuffer(t.encode(), np.uint8)], np.array([0, len(t.encode())]))[0])]
    first = cut(text)
    assert b"".join(first).decode() == text and max(map(len, first)) <= chunk_dedup.MAX_CHUNK
    second = cut("inserted words " + text[:9000] + " and more " + text[9000:])
    assert len(set(first) - set(second)) < 12


def passages(seed):
    rng = random.Random(seed)
    shared = [prose(rng, 60, 10**5) for _ in range(20)]
    rows, want = [], {}
    first: dict = {}
    for i in range(200):
        text = prose(rng, 150, 10**5)
        if i % 2:
            k = rng.randrange(20)
            text = text[:300] + " " + shared[k] + "\n" + text[300:]
            if k in first:
                want[i] = first[k]
            first.setdefault(k, i)
        rows.append((i, text))
    return rows, want


def test_repeated_passages_are_found_and_clean_texts_left(spark):
    rows, want = passages(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in chunk_dedup.dedup_passages(docs).collect()}
    assert set(want) == set(got) and all(f in got[i]["first_ids"] for i, f in want.items())
    for i, r in got.items():
        text = dict(rows)[i]
        rest = text
        for s in reversed(r["spans"]):
            rest = rest[:s["start"]] + rest[s["start"] + s["size"]:]
        assert rest == r["kept_text"] and r["n_chars"] == len(text) - len(rest)
    short = {r["doc_id"]: r.asDict() for r in chunk_dedup.passage_summary(docs).collect()}
    assert {i: {c: r[c] for c in short[i]} for i, r in got.items()} == short


def test_chunk_dedup_edges(edge_docs, no_docs):
    got = {}
    for r in chunk_dedup.dedup_passages(edge_docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert all(r["kept_text"] == "" and r["first_ids"] == [4] for r in got[5]) and len(got[5]) == 2
    assert 4 not in got and not {1, 2, 3} & set(got)
    assert chunk_dedup.dedup_passages(no_docs).count() == 0 and chunk_dedup.passage_summary(no_docs).count() == 0


def test_op4_gives_every_document_its_kept_text(spark, tmp_path, edge_docs, edge_rows):
    rows, want = passages(2)
    spark.createDataFrame([*rows, (900, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op4_chunk_dedup(spark, str(tmp_path)).collect()}
    lost = {r["doc_id"]: r for r in chunk_dedup.dedup_passages(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert set(got) == {*range(200), 900} and set(lost) == set(want)
    for i, text in [*rows, (900, "")]:
        kept = lost[i]["kept_text"] if i in lost else text
        assert got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        assert (got[i]["n_passages"], got[i]["first_ids"]) == ((lost[i]["n_passages"], lost[i]["first_ids"]) if i in lost else (0, []))
    assert chunk_dedup.kept_texts(edge_docs).count() == len(edge_rows)


def test_passages_without_blanks_are_removed(spark):
    rng = random.Random(9)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    shared, short = han(600), han(40)
    docs = spark.createDataFrame([(1, han(200) + shared + han(100)), (2, han(150) + shared + han(200)), (3, han(300) + short), (4, short + han(300))],
                                 "doc_id long, text string")
    got = {r["doc_id"]: r for r in chunk_dedup.dedup_passages(docs).collect()}
    assert set(got) == {2} and got[2]["first_ids"] == [1] and 400 < got[2]["n_chars"] <= 600 and len(got[2]["kept_text"]) == 950 - got[2]["n_chars"]
