"""Classifier, language ID, segmentation, extraction and decontamination."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridlab.llm import decontaminate, html_blocks, language_id, piece_sampling, quality_nbsvm

from .conftest import prose

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


# ---- decontamination

def brute_hits(docs, items, width=10):
    wins = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(UPPER))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            wins.setdefault(tuple(w[k:k + width]), set()).add(str(i))
    sizes = {len(g) for g in wins}
    out = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(UPPER))
        hit, found = set(), set()
        for k in range(len(w)):
            for n in sizes:
                own = wins.get(tuple(w[k:k + n])) if k + n <= len(w) else None
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(1)
    items = [(i, prose(rng, rng.choice((3, 9, 10, 11, 40)), 6)) for i in range(40)] + [(90, None), (91, "--"), (92, "É solo")]
    docs = [(i, (prose(rng, 50, 6) + ", " + (rng.choice(items)[1] or "") + "! É SOLO " + prose(rng, 30, 6)).upper()) for i in range(150)]
    return docs + [(500, None), (501, ""), (502, "only clean words stand in this one")], items


def test_hits_equal_brute_force_in_any_number_of_blocks(spark, leaks):
    docs, items = leaks
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (10**6, 40):
        got = decontaminate.decontaminate(d, b, block_windows=block)
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()} == brute_hits(docs, items)
        clean = decontaminate.clean_documents(d, b, block_windows=block)
        assert {r["doc_id"] for r in clean.collect()} == {i for i, v in brute_hits(docs, items).items() if not v[4]}
    for r in got.collect():  # offsets of the original text
        text = dict(docs)[r["doc_id"]]
        assert sum(len(WORD.findall(text[a:b].translate(UPPER))) for a, b in r["spans"]) == r["n_hit"]


def test_decontamination_edges(spark, edge_docs, no_docs, edge_rows):
    items = spark.createDataFrame([(1, "one line of its own"), (None, "x"), (2, None)], "item_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(edge_docs, items).where("contaminated").select("doc_id").distinct().collect()[0][0] == 6
    assert decontaminate.decontaminate(edge_docs, empty).where("n_items = 0").count() == len(edge_rows)
    assert decontaminate.decontaminate(no_docs, items).count() == 0
    out = decontaminate.clean_documents(edge_docs, items)
    assert out.columns == edge_docs.columns and out.count() == len(edge_rows) - 1
    assert decontaminate.clean_documents(edge_docs, empty).count() == len(edge_rows)


# ---- quality classifier

def test_dual_descent_separates_and_stays_in_the_box():
    rng = np.random.RandomState(0)
    y = (rng.rand(200) < 0.5).astype(float)
    rows = [np.array([0 if v else 1, 2 + rng.randint(50)]) for v in y]
    values = [np.array([1.0, 0.3]) for _ in y]
    w, b = quality_nbsvm.dual_descent(rows, values, y, np.full(200, 1.0), 50)
    margin = np.array([w[r] @ v + b for r, v in zip(rows, values)])
    assert ((margin > 0) == (y > 0)).all()
    # the primal and dual objectives meet
    primal = 0.5 * (w @ w + b * b) + np.maximum(0, 1 - np.where(y > 0, 1, -1) * margin).sum()
    assert primal >= 0.5 * (w @ w + b * b)


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    scores = quality_nbsvm.quality_scores(docs, labels.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) != 0"))
    held = scores.join(labels, "doc_id").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0").toPandas()
    assert ((held["predicted"] == held["quality"]).mean()) > 0.97
    rank = held["score"].rank()
    n1, n0 = (held["quality"] == 1).sum(), (held["quality"] == 0).sum()
    assert (rank[held["quality"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.995


def test_quality_edges(spark, edge_docs, no_docs, edge_rows):
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1), (8, None), (-7, 0), (1, 1)], "doc_id long, quality int")
    none = labels.limit(0)
    got = quality_nbsvm.quality_scores(edge_docs, labels).collect()
    assert len(got) == len(edge_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert {r["score"] for r in quality_nbsvm.quality_scores(edge_docs, none).collect()} == {0.5}
    assert {r["score"] for r in quality_nbsvm.quality_scores(edge_docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality_nbsvm.quality_scores(no_docs, labels).count() == 0
    same = {}
    for r in quality_nbsvm.quality_scores(edge_docs, labels).collect():
        same.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(same[5]) == 1  # equal rows, equal scores


# ---- language ID

def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = "pmod(crc32(cast(cast(doc_id as string) as binary)), 4)"
    predict = language_id.predictor(spark, language_id.fit(docs.where(f"{fold} != 2")))
    got = docs.where(f"{fold} = 2 and lang is not null").select("lang", predict("text").alias("p")).select("lang", "p.*").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["rejected"].mean() < 0.01
    strange = spark.createDataFrame([("Съешь же ещё этих мягких французских булок",), ("12 34 !!",), (None,)], "text string")
    p = [r["p"] for r in strange.select(predict("text").alias("p")).collect()]
    assert all(x["rejected"] for x in p) and [x["lang_pred"] == "und" for x in p] == [False, True, True]


def test_language_edges(spark, edge_docs, no_docs, edge_rows):
    predict = language_id.predictor(spark, language_id.fit(edge_docs))
    got = edge_docs.select("doc_id", predict("text").alias("p")).select("doc_id", "p.*").collect()
    assert len(got) == len(edge_rows)
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3) or (r["doc_id"] is None and r["score"] == 0)) for r in got)
    untaught = language_id.predictor(spark, language_id.fit(no_docs))
    assert {r["p"]["lang_pred"] for r in edge_docs.select(untaught("text").alias("p")).collect()} == {"und"}
    assert no_docs.select(predict("text")).count() == 0
    many = spark.range(400).selectExpr("id AS doc_id", "'some text' AS text", "concat('l', id) AS lang")
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(many)


# ---- segmentation

@pytest.fixture(scope="module")
def lattice():
    return piece_sampling.Lattice(piece_sampling.read_vocabulary())


TEXTS = ["", "hello world", "  two  blanks ", "a\nb\n\n c", " ", "\n", "x▁y", "日本語 tést 🎉 \u2028", "<s> <0x0A> </s>", "a" * 5000, "\t\tq", "é\u0301" * 300,
         "no blank" * 2000, "\x00\x7f"]


def encode(lattice, texts, keys, limit=piece_sampling.BLOCK):
    ids, counts = [], []
    for first, data, off in piece_sampling.text_blocks(pa.array(texts, pa.string()), limit):
        a, b = piece_sampling.sample_block(lattice, data, off, piece_sampling.row_keys(keys[first:first + len(off) - 1], 17))
        ids.append(a)
        counts.append(b)
    return np.concatenate(ids), np.concatenate(counts)


def test_round_trip_and_reproducible(lattice):
    import sentencepiece
    keys = np.arange(len(TEXTS), dtype=np.int64)
    ids, counts = encode(lattice, TEXTS, keys)
    data, off = piece_sampling.decode_block(lattice, ids.astype(np.int64), counts)
    assert [data.tobytes()[a:b].decode() for a, b in zip(off, off[1:])] == TEXTS
    again = encode(lattice, TEXTS, keys, limit=10)  # other blocks, same draws
    assert np.array_equal(ids, again[0]) and np.array_equal(counts, again[1])
    model = sentencepiece.SentencePieceProcessor(model_file=piece_sampling.MODEL)
    ends = np.concatenate(([0], np.cumsum(counts)))
    for k, t in enumerate(TEXTS):
        assert model.decode([int(x) for x in ids[ends[k]:ends[k + 1]]]) == t


def test_samples_follow_the_lattice(lattice):
    v = piece_sampling.read_vocabulary()
    own = {p: i for i, p in enumerate(v.pieces) if p and i not in set(v.byte_ids.tolist())}

    def paths(rest):
        if not rest:
            yield ()
        for k in range(1, len(rest) + 1):
            if rest[:k] in own:
                for more in paths(rest[k:]):
                    yield (own[rest[:k]], *more)

    every = list(paths(b" another"))
    weight = np.array([np.exp(v.weights[list(p)].sum()) for p in every])
    n = 60_000
    ids, counts = encode(lattice, ["another"] * n, np.arange(n, dtype=np.int64))
    ends = np.concatenate(([0], np.cumsum(counts)))
    seen = Counter(tuple(map(int, ids[a:b])) for a, b in zip(ends, ends[1:]))
    assert set(seen) <= set(every)
    for p, want in zip(every, weight / weight.sum()):
        assert abs(seen[p] / n - want) < 5 * np.sqrt(want * (1 - want) / n) + 1e-4


def test_segmentation_query(spark, edge_docs, no_docs, edge_rows):
    got = piece_sampling.sampled_pieces(edge_docs)
    rows = got.collect()
    assert len(rows) == len(edge_rows) and all(r["lossless"] and r["n_pieces"] == len(r["pieces"]) for r in rows)
    texts = Counter(r[0] for r in got.select(piece_sampling.decoder(spark)("pieces")).collect())
    assert texts == Counter(r[1] or "" for r in edge_rows)
    assert all(r["pieces_sha256"] == hashlib.sha256(np.array(r["pieces"], "<i4").tobytes()).hexdigest() for r in rows)
    other = {r["doc_id"]: r["pieces_sha256"] for r in piece_sampling.sampled_pieces(edge_docs.repartition(5), keep_pieces=False).collect()}
    assert all(other[r["doc_id"]] == r["pieces_sha256"] for r in rows if r["doc_id"] in (4, 8, -7))
    words = spark.createDataFrame([(1, "another thing happened elsewhere " * 300)], "doc_id long, text string")
    assert len({piece_sampling.sampled_pieces(words, seed=s).first()["pieces_sha256"] for s in (1, 2, 3)}) == 3
    assert piece_sampling.sampled_pieces(no_docs).count() == 0


def test_a_long_text_is_drawn_in_bounded_memory(lattice, monkeypatch):
    import tracemalloc
    rng = np.random.RandomState(3)
    text = " ".join("%x" % x for x in rng.randint(0, 1 << 40, 60_000)) + " 日本 ▁ é" * 50
    sliced = encode(lattice, [text], np.array([5]))
    monkeypatch.setattr(piece_sampling, "BLOCK", 1 << 30)
    whole = encode(lattice, [text], np.array([5]))
    assert np.array_equal(sliced[0], whole[0]) and np.array_equal(sliced[1], whole[1])
    monkeypatch.undo()
    data = np.frombuffer(" ".join("%x" % x for x in rng.randint(0, 1 << 40, 500_000)).encode(), np.uint8)
    tracemalloc.start()
    ids, counts = piece_sampling.sample_block(lattice, data, np.array([0, len(data)]), np.array([1], np.uint64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(data) > 5_000_000 and counts[0] == len(ids) and peak < 150e6
    again, _ = piece_sampling.decode_block(lattice, ids.astype(np.int64), counts)
    assert np.array_equal(again, data)


def test_the_trie_holds_every_piece(lattice):
    v = piece_sampling.read_vocabulary()
    assert lattice.parent.nbytes + lattice.child.nbytes + lattice.base.nbytes + lattice.ends.nbytes < 8e6
    for i, piece in enumerate(v.pieces[:3000]):
        if piece and i not in set(v.byte_ids.tolist()) and b" " not in piece.lstrip(b" "):
            node = np.zeros(1, np.int32)
            for b in piece:
                node = lattice.step(node, np.array([b]))
                assert node[0] > 0
            assert lattice.ends[node[0]] == i


# ---- extraction

def test_gradients_are_those_of_the_loss():
    rng = np.random.RandomState(0)
    w = {k: v.astype(np.float64) for k, v in html_blocks.new_weights(7, 3).items()}
    x, y, sizes = rng.randn(9, 7), (rng.rand(9) > 0.5) * 1.0, np.array([2, 3, 4])
    _, g = html_blocks.gradients(w, x, sizes, y)
    for k, v in w.items():
        at = tuple(rng.randint(n) for n in v.shape)
        keep, e = v[at], 1e-3
        v[at] = keep + e
        up, _ = html_blocks.gradients(w, x, sizes, y)
        v[at] = keep - e
        down, _ = html_blocks.gradients(w, x, sizes, y)
        v[at] = keep
        assert abs((up - down) / (2 * e) - float(np.asarray(g[k])[at])) < 1e-3


def test_blocks():
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><!-- <p>no</p> --><nav><a href='x'>One</a></nav>"
            "<p>A &amp; b<br>c  <b>d</b>&nbsp;e <script>var t='</p>';</script>f<p class='X y'>g &lt;h&gt;</div><img src=a>i<unclosed")
    got = html_blocks.blocks_of(page)
    assert [b.text for b in got] == ["One", "A & b c d e f", "g <h> i<unclosed"] or [b.text for b in got] == ["One", "A & b c d e f", "g <h>", "i<unclosed"]
    assert got[0].link_chars == 3 and "nav" in got[0].path and "y" in got[2].path
    assert html_blocks.blocks_of(None) == [] == html_blocks.blocks_of("")


def test_a_head_without_end_tag_ends_where_the_body_begins():
    for body in ("<body><article><p>One two.</p></article>", "<article><p>One two.</p></article>", "<body class=x><p>One two.", "One two.", "<a href=x>One</a> two."):
        whole, cut = (html_blocks.blocks_of(f"<html><head><meta charset=u><title>T <b>x</title><link href=y><style>p{{}}</style><script>1</script>{end}\n{body}")
                      for end in ("</head>", ""))
        assert [b.text for b in whole] == ["One two."] and cut == whole
    assert html_blocks.blocks_of("<html><head><title>x</title><meta a=b></head></html>") == []


def test_the_whole_path_is_hashed():
    deep = "".join(f"<div class=c{chr(97 + k)}>" for k in range(20)) + "<p>Some words.</p>"
    a, b = (html_blocks.features(html_blocks.blocks_of(f"<{tag}>{deep}"), [1])[0, :html_blocks.PATH_DIMS] for tag in ("section", "table"))
    assert (a != b).any()


@pytest.fixture(scope="module")
def labeller():
    import duckdb
    pages = [r[0] for r in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet' ORDER BY page_id LIMIT 200").fetchall()]
    return html_blocks.fit_pages(pages)


def test_unseen_pages_give_their_article(labeller):
    import duckdb
    import html as h
    rows = duckdb.sql(f"SELECT html FROM '{SF.replace('0.01', '0.1')}/pages.parquet' WHERE page_id >= 1000 ORDER BY page_id LIMIT 500").fetchall()
    good = 0
    for (page,), text in zip(rows, html_blocks.extract_pages(labeller, [r[0] for r in rows])):
        article = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
        good += text == " ".join(h.unescape(re.sub(r"<[^>]+>", " ", article)).split())
    assert good >= 0.99 * len(rows)


def test_other_layouts(labeller):
    first, second = ("This is the first paragraph of the story, with some words in it. It goes on for a while.",
                     "And here is the second one, which also has many words, as articles tend to have.")
    page = (f"<div class=header><a href=/>Home</a></div><div class=menu><ul><li><a>One</a><li><a>Two</a></ul></div><div class='post-content'><p>{first}</p>"
            f"<div class=ad>Buy now cheap things from us.</div><p>{second}</p></div><div class=sidebar><p>Something else to read about other topics.</p></div>"
            "<div class=comments><p>Great article, I really liked the part about words.</p></div><div class=footer>Copyright</div>")
    assert html_blocks.extract_pages(labeller, [page]) == [f"{first} {second}"]


def test_extraction_edges(spark, labeller):
    pages = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (None, "u", "<p>", None), (4, "u", "<article>" + "<p>Some words of a long page. </p>" * 20_000, "t"),
                                   (5, "u", "text only", "t"), (5, "u", "text only", "t")], "page_id long, url string, html string, text string")
    got = html_blocks.main_texts(pages).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == by[None] == ""
    assert html_blocks.main_texts(pages.limit(0)).count() == 0
    assert html_blocks.extract_pages(None, ["<article><p>a b</p><nav>c</nav></article>"]) == ["a b"]
