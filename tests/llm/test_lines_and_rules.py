"""Line dedup, quality rules and URL reputation against brute force."""
import hashlib
import random
import re

from pyspark.sql import functions as F

from gridlab.llm import line_runs, quality_rules, url_reputation

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def kept_lines(rows):
    """Brute force over (doc_id, text) with distinct ids."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    own: dict = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                own.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or i == min(own[key(x)])]
        out[i] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


def line_docs(seed, n=300):
    rng = random.Random(seed)
    pool = [f"Shared line number {k} of the pool" for k in range(60)] + ["short", "", " \t", "Éa Ünïcode line with Ä"]
    rows = []
    for i in rng.sample(range(-1000, 10_000), n):
        lines = [rng.choice((str.upper, str.lower, lambda s: s, lambda s: f"\t{s} \r"))(rng.choice(pool)) if rng.random() < 0.6
                 else f"own {i} {k} line" for k in range(rng.randrange(0, 12))]
        rows.append((i, "\n".join(lines) if rng.random() > 0.03 else None))
    return rows


def test_line_dedup_equals_brute_force(spark):
    rows = line_docs(1)
    for batches, fanout in ((1, 2), (4, 2), (7, 3)):
        got = line_runs.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches, fanout) \
            .select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()
        assert {r[0]: tuple(r[1:]) for r in got} == kept_lines(rows)


def test_runs_keep_every_key_once_and_compact(spark, tmp_path):
    runs = line_runs.LineRuns(spark, f"{tmp_path}/runs-test", 4, fanout=2)
    for b in range(5):
        keys = spark.range(b * 50, b * 50 + 100).select(F.col("id").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(b).cast("long").alias("id"))
        runs.add(keys)
    assert [len(level) for level in runs.levels] == [1, 0, 1]  # 5 = 4 + 1 batches
    got = {r["h1"]: r["id"] for r in runs.keys().collect()}
    assert runs.keys().count() == len(got) == 300
    assert got == {k: max(0, k // 50 - 1) for k in range(300)}
    runs_joined = spark.table(runs.names()[0]).join(spark.table(runs.names()[1]).hint("merge"), ["h1", "h2"], "left_anti")
    assert "Exchange" not in runs_joined._jdf.queryExecution().executedPlan().toString()  # runs are not dealt out again
    runs.close()


def test_line_dedup_edges(edge_docs, no_docs, edge_rows):
    got = line_runs.dedup_lines(edge_docs).collect()
    assert len(got) == len(edge_rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["n_lines"] == 1 and by[1][0]["kept_text"] == ""
    assert by[4][0]["n_dropped"] == 0 and all(r["n_dropped"] == 900 and r["kept_text"] == "" for r in by[5])
    assert [r["n_dropped"] for r in by[6]] == [0, 0]  # one document to the rule
    assert sorted(r["n_dropped"] for r in by[None]) == [0, 1, 1]
    assert line_runs.dedup_lines(no_docs).count() == 0
    out = line_runs.replace_text(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == len(edge_rows)
    assert out.where("doc_id = 1 and text is null").count() == 1
    assert line_runs.replace_text(no_docs).count() == 0


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    inside = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 5)} if len(grams) < 3000 else None
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(inside) if inside is not None else None)


def test_rule_counts_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "#é", "x|y", "\n", "\t\x0b"]) for _ in range(rng.randrange(0, 80)))) for i in range(200)]
    got = quality_rules.rule_results(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        want = base_counts(dict(rows)[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_rules_judge_lines(spark):
    prose = "This is a sentence that a person wrote, and it goes on. Then there is one more of them here."
    cases = {
        1: (prose, True), 2: (f"Home | News | Sport | Weather | About\n{prose}", True),
        3: ("Home | News | Sport | Weather | About | Contact | Login | Imprint | Legal | Help", False),
        4: ("BUY!! NOW!! CHEAP!! PILLS!! ONLY!! TODAY!! HERE!! FOR!! YOU!! ALL!! OF!! THEM!!", False),
        5: ("All rights reserved. Privacy policy and terms of use apply to all the pages here.", False),
        6: ("a%%% of### the$$$ is*** on&&& to%%% we### go$$$ up*** or&&& by%%% it###.", False), 7: ("word " * 40, False), 8: (None, False)}
    rows = [(k, v[0]) for k, v in cases.items()]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.rule_results(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_rules_edges_and_plan(edge_docs, no_docs, edge_rows):
    out = quality_rules.rule_results(edge_docs)
    assert out.count() == len(edge_rows) and quality_rules.rule_results(no_docs).count() == 0
    assert out.where("n_words = 0 and not base_failed").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_urls_and_rules(spark):
    urls = {1: "https://Www.Example.ORG/es/a?b", 2: "http://example.org/en/12#x", 3: "https://a.com/fr/", 4: "http://b.com/de/x", 5: None,
            6: "no scheme", 7: "x://org", 8: "http://h.net?q=http://org/", 9: "http://notexample.org/en/1", 10: "://", 11: "ftp://a://b/c"}
    pages = spark.createDataFrame([(k, u, "p", "h") for k, u in urls.items()], "page_id long, url string, path string, host string")
    none = spark.createDataFrame([], "url string, good int")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_reputation.judge_urls(pages.select("page_id", "url", "path", "host"), none).collect()}
    assert got == {
        1: ("www.example.org", "/es/a", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"),
        3: ("a.com", "/fr/", "com/fr/", "allow"), 4: ("b.com", "/de/x", "com/de/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("org", "", None, "allow"), 8: ("h.net", "", None, "allow"), 9: ("notexample.org", "/en/1", "org/", "allow"),
        10: ("", "", None, "allow"), 11: ("a:", "//b/c", None, "allow")}
    assert url_reputation.judge_urls(pages.limit(0), none).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    rows = [("http://bad.x.net/", 0)] * 60 + [("http://good.x.net/", 1)] * 60 + [("http://rare.y.org/", 0)] + [("http://z.org/", 1)] * 40 + [("http://z.org/", None)]
    outcomes = spark.createDataFrame(rows, "url string, good int")
    table, rate = url_reputation.fit_reputation(outcomes)
    got = {r["host"]: r.asDict() for r in table.collect()}
    assert abs(rate - 100 / 161) < 1e-12
    assert got["bad.x.net"]["upper"] < 0.5 < got["rare.y.org"]["upper"]  # one outcome is not enough
    for r in got.values():  # between the own rate and the prior
        lo, hi = sorted((r["good"] / r["n"], r["prior"]))
        assert lo <= r["mean"] <= hi
    pages = spark.createDataFrame([(1, "http://bad.x.net/q"), (2, "http://good.x.net/"), (3, "http://new.com/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_reputation.judge_urls(pages, outcomes).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_hosts_without_outcomes_are_judged_by_their_parents(spark):
    rows = [(f"http://h{k}.bad.net/", 0) for k in range(30)] * 10 + [(f"http://d{k}.worse/", 0) for k in range(30)] * 10 + [("http://z.org/", 1)] * 1000 \
        + [(f"http://e{k}.net/", 1) for k in range(30)] * 10
    outcomes = spark.createDataFrame(rows, "url string, good int")
    urls = ["http://new.bad.net/", "http://bad.net/", "http://new.worse/", "http://new.net/", "http://new.com/", "http://h1.bad.net/q", "no scheme", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_reputation.judge_urls(pages, outcomes).collect()}
    assert [got[k]["verdict"] for k in range(8)] == ["block"] * 3 + ["allow"] * 2 + ["block"] + ["allow"] * 2
    levels, _ = url_reputation.fit_levels(outcomes)
    bound = {level: {r[level]: r["upper"] for r in table.collect()} for level, table in levels.items()}
    assert got[0]["upper"] == got[1]["upper"] == bound["domain"]["bad.net"] and got[2]["upper"] == bound["suffix"]["worse"]
    assert got[3]["upper"] == bound["suffix"]["net"] and got[5]["upper"] == bound["host"]["h1.bad.net"]
    assert got[4]["upper"] is got[6]["upper"] is got[7]["upper"] is None
