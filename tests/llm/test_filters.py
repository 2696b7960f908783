"""Quality rules, URL filter and toxicity: edge cases and brute force."""

import re
import zlib
from collections import Counter

import pytest

from helixloom.llm import quality, toxicity, urls

SF = "/root/testdata/sf0.01"


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + extra)


ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b\x0c\r ", "en", "a", 7), (None, "one two three four five six seven eight nine ten", "en", "a", 1), (4, "x y " * 9, "en", "b", 36),
    (5, "a b c d e\n" * 3 + "a b c d e f\n\n\n", "en", None, 1), (5, "a b c d e\n" * 3 + "a b c d e f\n\n\n", "en", None, 1), (6, "## $ | <b> & %% *\u00a0é word\u2003x", "en", "b", 1),
    (7, " ".join(f"w{i}" for i in range(20000)), "en", "b", 1), (8, "p q r s t u v w x y p q r s t z z z z z", "en", "b", 1),
]


def brute_quality(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_quality_metrics_match_brute_force(spark):
    got = quality.judge(docs(spark, ODD), keep=["doc_id", "text"]).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert tuple(r[c] for c in quality.METRICS) == brute_quality(r["text"]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


def test_hosts_are_refused_by_their_shrunk_rate(spark):
    good = "one two three four five six seven eight nine ten"
    rows = [(i, "bad", "en", "farm", 1) for i in range(50)] + [(100 + i, good, "en", f"h{i % 5}", 1) for i in range(50)] + [(200, good, "en", "farm", 1), (201, "bad", "en", "single", 1)]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs(spark, rows)).collect()}
    assert not kept[200] and all(kept[100 + i] for i in range(50))


def test_symbols_and_duplicate_lines_are_rules_and_count_for_the_host(spark):
    good = "one two three four five six seven eight nine ten"
    marked = good.replace(" ", "### ")
    lines = "\n".join(["one two three four", "five six", "one two three four", "seven eight nine ten", "one two three four"])
    rows = [(1, good, "en", "a", 1), (2, marked, "en", "a", 1), (3, lines, "en", "a", 1)] + [(10 + i, good, "en", f"h{i % 8}", 1) for i in range(80)]
    rows += [(100 + i, marked, "en", "farm", 1) for i in range(45)] + [(200 + i, good, "en", "farm", 1) for i in range(45)]
    got = quality.judge(docs(spark, rows)).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == {1, *range(10, 90)}  # half of the farm's rows fail: below 0.6, far above all others
    assert not any(r["base_failed"] for r in got)


def test_symbol_junk_does_not_stay_in_the_corpus(spark):
    d, y = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.judge(d, keep=["doc_id"]).join(y.where("quality = 0"), "doc_id").collect()
    assert sum(r["kept"] for r in rows) <= 0.1 * len(rows)


def test_quality_stage_keeps_columns_and_empty_tables(spark):
    named = docs(spark, [(1, "one two three four five six seven eight nine ten", "en", "a", 1, "x", True)], ", n_words string, kept boolean")
    out = quality.quality_stage(named)
    assert out.columns == named.columns and out.collect()[0]["n_words"] == "x"
    assert quality.quality_stage(named.limit(0)).count() == 0


def test_url_rules(spark):
    rows = [
        ("http://Sub.Example.NET/en/a?x", "example.net/en/", "allow"), ("http://example.net/en", "net/", "block"), ("https://net/", "net/", "block"), ("https://net", None, "allow"),
        ("http://notexample.com/de/", None, "allow"), ("http://a.example.com/de/1#x", "example.com/de/", "block"), ("http://x.org/fr/", "org/fr/", "allow"), ("no scheme", None, "allow"), (None, None, "allow"),
        ("http://example.com?/de/", None, "allow"), ("x://y://example.com/de/", None, "allow"), ("://a.net//en/", "net/", "block"), ("", None, "allow"), ("http://a.net/x", "net/", "block"), ("http://a.net/x", "net/", "block"),
        ("http://" + "a." * 3000 + "net/" + "p/" * 50, "net/", "block"), ("http://" + "a." * 300_000 + "example.net/en/" + "p/" * 200_000, "example.net/en/", "allow"),
        ("http://..net/", "net/", "block"), ("http://xexample.net/en/", "net/", "block"), ("http://" + "y" * 90 + ".org/fr/", "org/fr/", "allow"), ("http://example.net./en/", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, (u, _, _) in enumerate(rows)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(pages, urls.rule_table(spark)).collect()}
    assert got == {i: (r, v) for i, (_, r, v) in enumerate(rows)}
    assert urls.judge_urls(pages.limit(0), urls.rule_table(spark)).count() == 0


def test_rule_paths_need_no_slash_at_their_end_and_ties_are_ordered(spark):
    rules = urls.rule_table(spark, [("a.com", "/pre", "block"), ("a.com", "", "allow"), ("b.a.com", "/p", "allow"), ("x.com", "/y", "block"), ("x.com", "/y", "allow"), (None, "/", "block")])
    pages = spark.createDataFrame([(1, "h://a.com/prefix/z"), (2, "h://a.com"), (3, "h://b.a.com/pre"), (4, "h://x.com/y")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(pages, rules).collect()}
    assert got == {1: ("a.com/pre", "block"), 2: ("a.com", "allow"), 3: ("b.a.com/p", "allow"), 4: ("x.com/y", "block")}


def test_toxicity_learns_unseen_insults_and_leaves_clean_texts_alone(spark):
    clean = [f"the quiet river runs past house number {i} and the old mill" for i in range(150)]
    toxic = [f"the quiet gronk runs past house {i} you blarf" for i in range(60)]
    texts = clean + toxic
    d = docs(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, 1, int(i >= 150)) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(d, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r["predicted"] == int(r["doc_id"] >= 150) for r in held)


def test_toxicity_edge_cases(spark):
    d = docs(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(d, none).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got)
    odd = spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, 1, 1), (2, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(d, odd).count() == len(ODD)
    assert toxicity.score_toxicity(d.limit(0), odd).count() == 0
    out = toxicity.toxicity_stage(d.withColumn("score", d.text), odd)
    assert out.columns == [*d.columns, "score"]


@pytest.mark.parametrize("fold", [True])
def test_toxicity_held_out_accuracy(spark, fold):
    d, y = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.score_toxicity(d, y).join(y, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right >= 0.9 * len(rows) and not any(r["predicted"] for r in rows if not r["toxic"])


def test_shouting_reads_the_whole_text():
    m = toxicity.Model([], [])
    at = m.n_lexical + toxicity.PATTERNS.index("shouting")
    step = "A" + "b" * 4999  # capitals only where one in 5,000 characters is read
    for t, shouts in [("A" * 100 + "b" * 299, False), ("A" * 200 + "b" * 199, True), (step * 200, False), ("b" + "A" * 4999, True), ("É" * 50 + "é" * 50, True), ("É" * 49 + "é" * 51, False),
                      ("A" * 50 + "b" * 50, True), ("AB", True), ("Ab", True), ("abC", False), ("", False), (None, False)]:
        assert (at in m.votes(t)[0]) == shouts, (t or "")[:20]


def test_label_model_shares_votes_of_correlated_voters():
    import numpy as np

    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    a = np.where(y, rng.random(4000) < 0.8, rng.random(4000) < 0.1)
    b = np.where(y, rng.random(4000) < 0.6, rng.random(4000) < 0.05)
    p, post, share = toxicity.label_model(np.column_stack([a, a, b]), y)
    assert share[0] < 0.6 and share[1] < 0.6 and share[2] > 0.9
    assert abs(p[2, 1] - 0.6) < 0.1 and ((post > 0.5) == y).mean() > 0.8
