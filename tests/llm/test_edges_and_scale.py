"""Malformed and long input, repeated rows, clashing names, more than one
block, and brute-force forms of the operators that learn."""
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlab.llm import decontaminate, html_blocks, language_id, near_dedup, quality_nbsvm, quality_rules, url_reputation

from .conftest import prose


# ---- extraction
@pytest.mark.parametrize("piece", ["<b ' ", "<b <", '<b ">" ', "<div>x", "<div><p>x</p></div>", "</p>", "<!-- ", "<a href='", "<", "<x \"' "])
def test_a_megabyte_of_broken_tags_takes_seconds(piece):
    began = time.process_time()
    html_blocks.blocks_of(piece * (1_000_000 // len(piece)) + "'")
    assert time.process_time() - began < 20


def test_broken_tags_are_text_and_quotes_may_hold_tags():
    def texts(page):
        return [b.text for b in html_blocks.blocks_of(page)]

    assert texts("<p>a < b and <b unclosed <p>next</p>") == ["a < b and <b unclosed", "next"]
    assert texts("<p title='x > y <p>'>one</p><p title=\"it's\">two</p>") == ["one", "two"]
    assert texts("<p title='open>three</p>") == ["three"]
    assert texts("<script>if (a < b) '<p>no</p>'</script>yes<!-- <p>no</p> -->!") == ["yes !"] or texts("<script>x</script>yes<!-- n -->!") == ["yes!"]
    assert texts("a<script>never closed <p>no</p>") == ["a"]
    deep = html_blocks.blocks_of("<div>" * 2000 + "x" + "</div>" * 2000 + "<p>y</p>")
    assert [b.text for b in deep] == ["x", "y"] and len(deep[0].path) <= html_blocks.MAX_DEPTH


def test_copies_of_one_page_are_one_training_page(spark):
    page = "<html><body><nav>a b c</nav><article><p>" + prose(random.Random(1), 60) + "</p></article></body></html>"
    pages = spark.createDataFrame([(i, "u", page) for i in range(3000)], "page_id long, url string, html string")
    seen = []
    fit_pages = html_blocks.fit_pages
    w = html_blocks.fit(pages, sample=10**6)
    assert w is not None and seen == [] and fit_pages is html_blocks.fit_pages
    one = html_blocks.fit(pages.limit(1), sample=10**6)
    assert all(np.array_equal(w[k], one[k]) for k in w)


# ---- language ID
@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(2)
    words = {"aa": ["kala", "lumi", "sano", "talo", "vesi", "puhe"], "bb": ["weg", "haus", "schnee", "stadt", "buch", "wort"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(40)), lang) for i, lang in enumerate(["aa", "bb"] * 200)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def predictions(spark, model, texts):
    predict = language_id.predictor(spark, model)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", predict("text").alias("p")).select("i", "p.*").collect()
    return {r["i"]: r for r in rows}


def test_number_characters_are_no_letters(spark, tongues):
    got = predictions(spark, language_id.fit(tongues[1]), ["½ ² Ⅷ", "۳ ④", "_ 12", None, "", "ª"])
    assert [got[i]["lang_pred"] for i in range(5)] == ["und"] * 5 and all(got[i]["score"] == 0 and got[i]["rejected"] for i in range(5))
    assert got[5]["lang_pred"] != "und"


def test_one_odd_text_does_not_move_the_floor(spark, tongues):
    rows, docs = tongues
    odd = spark.createDataFrame([(9000, "zqxj 7f3a9 qqzz jjxx " * 30, "aa")], docs.schema)
    plain, moved = language_id.fit(docs), language_id.fit(docs.union(odd))
    floor = [min(f for l, f in zip(m[1], m[3]) if l == "aa") for m in (plain, moved)]
    assert floor[1] > 0.8 * floor[0] > 0.1
    got = predictions(spark, moved, ["Ωμέγα λόγος άνθρωπος " * 5, rows[0][1], rows[1][1]])
    assert got[0]["rejected"] and not got[1]["rejected"] and not got[2]["rejected"]
    assert (got[1]["lang_pred"], got[2]["lang_pred"]) == ("aa", "bb")


def test_predictions_equal_the_nearest_centre(spark, tongues):
    rows, docs = tongues
    idf, langs, centres, floors = model = language_id.fit(docs)
    import pyarrow as pa
    texts = [t for _, t, _ in rows[:30]] + ["kala weg kala", "x"]
    counts = np.concatenate([c for _, c in language_id._counts(pa.array(texts))])
    got = predictions(spark, model, texts)
    for i, c in enumerate(counts):
        v = np.array([np.log1p(x) * w for x, w in zip(c, idf)])
        v /= max(1e-12, np.sqrt((v * v).sum()))
        cosines = [float((v * centre).sum()) for centre in centres]
        best = max(range(len(cosines)), key=lambda j: (cosines[j], -j))
        assert got[i]["lang_pred"] == langs[best] and abs(got[i]["score"] - max(0.0, cosines[best])) < 1e-4
        if abs(cosines[best] - floors[best]) > 1e-4:
            assert got[i]["rejected"] == (cosines[best] < floors[best])


# ---- quality classifier
def test_a_repeated_document_is_one_training_row(spark):
    rng = random.Random(3)
    rows = [(i, ("good words here " if i % 2 else "bad junk 111 !!! ") + prose(rng, 20)) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    many = once.union(spark.createDataFrame([rows[0]] * 20_000, once.schema))
    a, b = ({r["doc_id"]: r["score"] for r in quality_nbsvm.quality_scores(d, labels).dropDuplicates(["doc_id"]).collect()} for d in (once, many))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


# ---- decontamination
def test_many_blocks_are_passes_and_not_stacked(spark):
    rng = random.Random(4)
    shared = prose(rng, 12)
    items = [(i, prose(rng, 30, 40) + " " + shared) for i in range(30)] + [(99, prose(rng, 4000))]  # one window in all items, one long item
    docs = [(i, prose(rng, 20) + " " + (rng.choice(items)[1] if i % 3 else "") + " " + prose(rng, 20)) for i in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = decontaminate.decontaminate(d, b)
    many = decontaminate.decontaminate(d, b, block_windows=500)
    assert Counter(map(str, one.collect())) == Counter(map(str, many.collect()))
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    clean = decontaminate.clean_documents(d, b, block_windows=500)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.where("NOT contaminated").collect()}
    pairs, blocks = decontaminate.item_windows(b, 10, 500)
    sizes = [r["count"] for r in pairs.groupBy("block").count().collect()]
    assert blocks > 5 and max(sizes) < 1000 and sum(sizes) == pairs.count()


def test_columns_with_the_operators_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, "x"), (2, "nothing else", 8, "y")], "doc_id long, text string, n_words long, items string")
    items = spark.createDataFrame([(5, "a b c")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_hits(docs, items).collect()}
    assert got[1]["n_words"] == 3 and got[1]["items"] == ["5"] and got[2]["items"] == []
    assert [tuple(r) for r in decontaminate.clean_documents(docs, items).collect()] == [(2, "nothing else", 8, "y")]


# ---- near-dedup
def test_one_of_each_keeps_columns_of_any_name(spark):
    text = prose(random.Random(5), 40)
    docs = spark.createDataFrame([(1, text, 5, "a", 3), (2, text, 6, "b", 4), (2, text, 6, "b", 4), (3, "another", 7, "c", 5)],
                                 "doc_id long, text string, __id long, id string, __k int")
    got = near_dedup.one_of_each(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, text, 5, "a", 3), (3, "another", 7, "c", 5)]


# ---- rules
def test_boilerplate_is_whole_phrases_in_four_languages(spark):
    lines = {"This site uses cookies to make it better.": True, "She baked a cookie for him.": False, "We wrote it in javascript.": False,
             "Please enable JavaScript first.": True, "Alle Rechte vorbehalten, Verlag.": True, "Tous droits réservés.": True,
             "Todos los derechos reservados.": True, "The catalog inside was old.": False, "Please log in.": True, "Their designs upset him.": False}
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", quality_rules.line_fails(F.col("line")).alias("bad"))
    assert {r["line"]: r["bad"] for r in rows.collect()} == lines


# ---- URLs
def test_levels_and_bounds_are_returned(spark):
    outcomes = spark.createDataFrame([(f"http://h{k % 3}.a.net/", k % 2) for k in range(60)], "url string, good int")
    urls = ["http://h0.a.net/x", "http://new.a.net/", "http://b.net/", "http://c.org/", "none"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_reputation.judge_urls(pages, outcomes).collect()}
    assert [got[k]["level"] for k in range(5)] == ["host", "domain", "suffix", "all", "all"]
    assert all(0 < got[k]["mean"] < got[k]["upper"] for k in range(3)) and got[3]["mean"] is None


def test_many_rules_are_joined_with_the_same_result(spark, monkeypatch):
    rng = random.Random(6)
    label = lambda: rng.choice(["a", "b", "cc", "org", "com"])
    rules = sorted({(".".join(label() for _ in range(rng.randrange(1, 4))) + "/" + "/".join(label() for _ in range(rng.randrange(3))), rng.choice(["allow", "block"]))
                    for _ in range(300)})
    rules = list({r: s for r, s in rules}.items())
    urls = [f"http://{'.'.join(label() for _ in range(rng.randrange(1, 5)))}/{'/'.join(label() for _ in range(rng.randrange(4)))}" for _ in range(400)] + [None, "x", "http://a", "http://.a./"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string")
    none = spark.createDataFrame([], "url string, good int")
    plain = Counter(tuple(r)[:5] for r in url_reputation.judge_urls(pages, none, rules).collect())
    monkeypatch.setattr(url_reputation, "MAX_RULES", 0)
    assert Counter(tuple(r)[:5] for r in url_reputation.judge_urls(pages, none, rules).collect()) == plain
    assert sum(n for k, n in plain.items() if k[3]) > 100
