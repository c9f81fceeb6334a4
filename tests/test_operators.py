"""Operators that SQL can't express, and edge cases, against small literals."""

from __future__ import annotations

import math
import os
import random
import zipfile
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import answers as N
from tessera.functions import html_text as H
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import answers as W
from tessera.operators import caching as K
from tessera.operators import code_graph as CG
from tessera.operators import evidence as E
from tessera.operators import graph as G
from tessera.operators import lexical as L
from tessera.operators import metrics as M
from tessera.operators import retrieval as R
from tessera.sources import files


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_cjk_tokens(spark):
    assert one(spark, T.tokenize(F.col("t")), t="How 市场分 is fast-api") == ["fast-api", "市", "场", "分", "市场", "场分"]


def test_entities_and_space(spark):
    assert one(spark, T.clean_text(F.col("t")), t="  a&amp;b \t c ") == "a&b c"


def test_passages_cut_a_lone_long_sentence_evenly(spark):
    got = one(spark, T.split_passages(F.col("t"), 100, 20), t="x" * 250)
    assert got == ["x" * 100, "x" * 100, "x" * 90, "x" * 10]


def test_passages_carry_overlap(spark):
    got = one(spark, T.split_passages(F.col("t"), 25, 4), t="First sentence here. Second sentence here.")
    assert got == ["First sentence here.", "ere. Second sentence here."]


def test_sentences_keep_the_digits_of_their_place(spark):
    """``transform`` hands a function of two parameters the place too: trimming must not take that for what it trims."""
    t = "0 is first. 1 follows 1. 2 comes at 2"
    assert one(spark, T.sentences(F.col("t")), t=t) == ["0 is first.", "1 follows 1.", "2 comes at 2"]
    assert one(spark, T.split_passages(F.col("t")), t=t) == [t]
    assert one(spark, T.split_claims(F.col("t")), t=t) == ["0 is first.", "1 follows 1.", "2 comes at 2"]


def test_passages_and_tokens_of_one_text(spark):
    """Plain Python for tasks, the same as the columns."""
    long = " ".join(f"Sentence {i} has Words, of {i * 7} kinds! \u3000Does it end? yes。然后 市场分。 It-does_2 ." for i in range(60))
    texts = [None, "", " \t\n", "a", ". . ! ?", "a&nbsp;b &lt;c&gt;.\x1c\x85d. \u2003e&#33; f", "x" * 3000, "y" * 950 + ". z", long, long.upper()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    clean = T.clean_text(F.col("t"))
    for r in df.select("i", T.split_passages(clean).alias("p"), T.tokenize(F.col("t")).alias("k")).collect():
        text = texts[r["i"]]
        assert T.passages_of(text) == r["p"]
        assert text is None or [w for w in T.tokens_of(text.lower()) if w not in T.RANK_STOPWORDS] == r["k"]


def _evidence_docs(spark, rows):
    return spark.createDataFrame(rows, "did long, title string, url string, snippet string, provider string, text string")


def test_evidence_is_kept_small(spark, tmp_path):
    """What is written of the passages is less than their texts: not the texts, their lower case and their tokens."""
    words = [f"word{i}" for i in range(3000)]
    rng = random.Random(3)
    rows = [(i, f"Title {i}", f"http://a{i % 9}.org/{i}", "", "web", ". ".join(" ".join(rng.choices(words, k=12)) for _ in range(40))) for i in range(300)]
    queries = spark.createDataFrame([(k, " ".join(rng.choices(words, k=8))) for k in range(20)], "qid long, text string")
    sc, before = spark.sparkContext, spark.sparkContext.getCheckpointDir()
    sc.setCheckpointDir(str(tmp_path))
    try:
        assert E.rank_evidence(queries, _evidence_docs(spark, rows)).count() == 160
    finally:
        sc._jsc.sc().setCheckpointDir(before)
    written = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path) for f in names)
    assert 0 < written < sum(len(r[-1]) for r in rows)


def test_evidence_of_titles_snippets_and_copies(spark):
    text = "solar panels give power."
    rows = [
        (1, "Solar panels", "http://a.org/1", "", "web", text),
        (2, "Solar panels", "HTTP://A.org/1", "", "web", text),  # starts like 1 under the same URL
        (3, "Solar panels", "http://b.org/1", "all of solar panels", "web", text),
        (4, "Solar panels", "http://c.org/1", "", "official", text),
        (5, "xsolar panelsx", "http://d.org/1", "", "web", "Nothing here."),  # only the title has the phrase, inside of words
        (6, "Empty", "http://e.org/1", None, "web", None),
        (7, None, None, None, None, "tides rise."),
    ]
    queries = spark.createDataFrame([(1, "solar panels"), (2, ""), (3, None), (4, "unheard")], "qid long, text string")
    got = E.rank_evidence(queries, _evidence_docs(spark, rows)).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["did"], r["rank"]) for r in got] == [(1, 4, 1), (1, 3, 2), (1, 1, 3), (1, 5, 4)]
    assert got[3]["score"] == pytest.approx(0.08 * 0.55 * one(spark, U.source_quality(F.col("u")), u="http://d.org/1"))
    assert {r["passage"] for r in got[:3]} == {text} and got[0]["title"] == "Solar panels" and got[0]["provider"] == "official"


@pytest.mark.parametrize("domains, urls", [(1, 3), (2, 40), (4, 2), (30, 2), (30, 30)])
def test_best_of_parts_is_best_of_all(domains, urls):
    """Against the rule, row by row: the best of each URL and three of each domain first, then the rest."""
    rng = np.random.default_rng(domains * 100 + urls)
    n, queries, limit = 400, 6, 8
    url = [f"{rng.integers(domains)}/{rng.integers(urls)}" for _ in range(n)]
    score = rng.integers(0, 60, (queries, n)) / 7.0
    best = E._Best(queries, limit)
    for lo in range(0, n, 23):
        part = url[lo : lo + 23]
        at = np.arange(len(part))
        best.add(score[:, lo : lo + 23], at, at + lo, at * 0, pa.array(part), pa.array([u.split("/")[0] for u in part]))
    k, did = best.rows()[:2]
    for q in range(queries):
        first, rest, seen, used = [], [], set(), {}
        for i in sorted((i for i in range(n) if score[q, i] > 0), key=lambda i: (-round(score[q, i], 8), i)):
            domain = url[i].split("/")[0]
            lead = url[i] not in seen and used.get(domain, 0) < 3
            used[domain] = used.get(domain, 0) + (url[i] not in seen)
            seen.add(url[i])
            (first if lead else rest).append(i)
        assert sorted(did[k == q]) == sorted((first + rest)[:limit])


def test_code_tokens_repeat_plain_words(spark):
    assert one(spark, T.code_tokens(F.col("t")), t="getName(x_1) >= 2") == ["getname", "get", "name", "(", "x_1", "x", "1", ")", ">=", "2"]


@pytest.mark.parametrize("url, tier", [("https://www.nih.gov/a", "government"), ("https://sub.reddit.com", "low_signal"), ("https://notreddit.com", "general"), ("https://a.mit.edu/x", "government"), ("https://docs.python.org", "official_docs")])
def test_trust_tier(spark, url, tier):
    assert one(spark, U.trust_tier(F.col("u")), u=url) == tier


def test_bad_redirect_stays(spark):
    href = "https://www.bing.com/ck/a?u=a1!!!"
    assert one(spark, U.decode_redirect(F.col("u")), u=href) == href


def _expected(labels, scores, metric):
    """The mean over all orders of equal scores."""
    rows = list(zip(scores, labels))
    values = [metric([x[1] for x in order]) for order in permutations(rows) if all(a[0] >= b[0] for a, b in zip(order, order[1:]))]
    return sum(values) / len(values)


def _ap(order):
    hits, total = 0, 0.0
    for i, x in enumerate(order, 1):
        if x > 0:
            hits += 1
            total += hits / i
    return total / hits if hits else 0.0


def _rr(order):
    return next((1 / i for i, x in enumerate(order, 1) if x > 0), 0.0)


@pytest.mark.parametrize("labels, scores", [([1, 0, 1, 0], [0.5, 0.5, 0.5, 0.5]), ([0, 1, 0, 2, 0], [0.9, 0.5, 0.5, 0.5, 0.1]), ([0, 0], [1.0, 1.0])])
def test_tie_aware_metrics(spark, labels, scores):
    df = spark.createDataFrame([(1, l, s) for l, s in zip(labels, scores)], "qid long, label int, score double")
    row = M.tie_aware_metrics(df).first()
    assert row["map"] == pytest.approx(_expected(labels, scores, _ap))
    assert row["mrr"] == pytest.approx(_expected(labels, scores, _rr))
    ideal = sum((2**x - 1) / math.log2(i + 2) for i, x in enumerate(sorted(labels, reverse=True)))
    dcg = _expected(labels, scores, lambda o: sum((2**x - 1) / math.log2(i + 2) for i, x in enumerate(o)))
    assert row["ndcg"] == pytest.approx(dcg / ideal if ideal else 0.0)


def test_single_document_has_infinite_margin(spark):
    df = spark.createDataFrame([(1, 0.5)], "qid long, score double")
    assert M.top_margin(df).first()["margin"] == math.inf


def test_missing_run_scores_nothing(spark):
    run = spark.createDataFrame([(1, 10, 1)], "qid long, did long, rank int")
    good = spark.createDataFrame([(1, 10), (2, 11)], "qid long, did long")
    rows = {r["qid"]: r for r in M.run_metrics(run, good, good.select("qid")).collect()}
    assert rows[1]["ndcg"] == 1.0 and not rows[1]["missing"]
    assert rows[2]["ndcg"] == 0.0 and rows[2]["missing"]


def test_dense_search_in_blocks(spark):
    rows = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(40)], "id long, v array<double>")
    q, d = rows.where("id < 7").withColumnRenamed("id", "qid"), rows.withColumnRenamed("id", "did")
    whole = sorted(map(tuple, R.dense_top_k(q, d, 5).select("qid", "did", "rank").collect()))
    assert whole == sorted(map(tuple, R.dense_top_k(q, d, 5, block=2).select("qid", "did", "rank").collect()))
    assert len(whole) == 35


def test_dense_search_of_nothing(spark):
    empty = spark.createDataFrame([], "qid long, v array<double>")
    assert R.dense_top_k(empty, empty.withColumnRenamed("qid", "did"), 3).count() == 0


def test_fused_representative_prefers_official(spark):
    rows = [(1, 1, 1, "t", "http://h/a", "", "web"), (1, 1, 2, "u", "http://h/a/", "s" * 100, "web"), (1, 2, 1, "", "http://h/a#z", "", "official"), (1, 2, 2, "v", "http://h/a", "s" * 500, "web")]
    df = spark.createDataFrame(rows, "qid long, batch int, rank int, title string, url string, snippet string, provider string")
    got = E.fuse_results(df).collect()
    assert len(got) == 1 and got[0]["provider"] == "official" and got[0]["url"] == "http://h/a"


def test_evict_keeps_last_hit(spark):
    df = spark.createDataFrame([(i, i % 3, i) for i in range(9)], "cid long, last_hit long, created_at long")
    assert [r["cid"] for r in K.evict(df, 4).collect()] == [8, 5, 2, 7]


def test_cyclic_graph_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    assert {(r["node"], r["depth"]) for r in G.reach(edges, seeds, 10).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_phantom_and_unique_last_part(spark):
    nodes = spark.createDataFrame([("1", "A.run", 1), ("2", "B.stop", 2), ("3", "C.stop", 3)], "id string, name string, seq int")
    edges = spark.createDataFrame([("x", t, "CALLS") for t in ("1", "A.run", "self.run", "z.stop")], "src string, target string, kind string")
    got = {r["target"]: (r["dst"], r["phantom"]) for r in G.resolve_edges(edges, nodes).collect()}
    assert got == {"1": ("1", False), "A.run": ("1", False), "self.run": ("1", False), "z.stop": ("z.stop", True)}


SOURCE = '''"""Doc."""
import os
from a.b import c

def f(x):
    return g(x)

def g(x):
    return os.getcwd() or f(x)

class K(Base):
    def m(self):
        return f(1)
'''


def test_parse_and_trace(spark):
    files_df = spark.createDataFrame([("p/mod.py", SOURCE), ("p/bad.py", "def (")], "path string, content string")
    names = {(r["qualified"], r["kind"]) for r in CG.entities(files_df).collect()}
    assert {("f", "FUNCTION"), ("g", "FUNCTION"), ("K", "CLASS"), ("K.m", "FUNCTION")} <= names
    rel = {(r["src"].split("::")[1], r["target"], r["kind"]) for r in CG.relations(files_df).collect()}
    assert ("f", "g", "CALLS") in rel and ("K", "Base", "INHERITS") in rel and ("p.mod", "a.b.c", "IMPORTS") in rel
    nodes = CG.entities(files_df).withColumn("seq", F.col("start_line"))
    edges = G.resolve_edges(CG.relations(files_df).where("kind = 'CALLS'"), nodes.select("id", "name", "seq")).select("src", "dst", "kind")
    seeds = spark.createDataFrame([("p/mod.py::K.m",)], "seed string")
    steps = [r["node"].split("::")[1] for r in CG.trace_calls(nodes, edges, seeds).orderBy("step").collect()]
    assert steps == ["K.m", "f", "g"]


def test_communities_of_two_cliques(spark):
    pairs = [(f"{side}{i}", f"{side}{j}") for side in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")]
    got = {r["node"]: r["community"] for r in CG.communities(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and len({got[f"b{i}"] for i in range(5)}) == 1 and got["a1"] != got["b1"]


def test_extract_html():
    page = "<html><head><title>T &amp; U</title><meta name='description' content='About it'></head><body><nav>menu</nav><article><h1>short</h1><p>" + "word " * 80 + "<li>" + "item " * 20 + "</article><script>x</script></body></html>"
    title, text = H.page_text(page)
    assert title == "T & U" and text.startswith("About it word") and "menu" not in text and "short" not in text


def test_deep_and_broken_pages():
    deep = "<div>" * 30_000 + "<p>" + "word " * 80 + "</b>" * 30_000
    assert H.page_text(deep)[1] == ("word " * 80).strip()
    assert H.page_text("<form>" * 5000 + "gone") == ("", "") and H.page_text("", "t") == ("t", "")
    assert H.page_text("<p>a<script>b<p>c</script>d</nav>e")[1] == "a d e"


def test_result_blocks():
    page = "".join(f"<div class='result x'><a class='result__a' href='http://h/{i}'>T{i}</a><div class='result__snippet'>s</div></div>" for i in range(3)) + "<div class='result'>none</div>"
    assert H.result_blocks(page) == [(i + 1, f"T{i}", f"http://h/{i}", "s") for i in range(3)]


def test_result_pages(spark):
    """Limits count results with a web address, ranks all blocks; other engines and null pages give none."""
    block = "<li class='b_algo'><h2><a href='{}'>T</a></h2><p>plain</p></li>"
    pages = [(1, block.format("/x") + block.format("https://a") + block.format("https://b") + block.format("https://c"), "bing"), (2, None, "bing"), (3, "<div class='result'></div>", "other")]
    rows = H.search_results(spark.createDataFrame(pages, "page long, html string, engine string"), 2).collect()
    assert [(r["page"], r["url"], r["snippet"], r["rank"]) for r in rows] == [(1, "https://a", "plain", 2), (1, "https://b", "plain", 3)]


def _answers(spark, query, *rows):
    """One question's evidence: (id, title, url, provider, score, passage)."""
    evidence = spark.createDataFrame([(1, *r) for r in rows], "qid long, id long, title string, url string, provider string, score double, passage string")
    return W.gathered(spark.createDataFrame([(1, query), (2, query)], "qid long, query string"), evidence)


SOLAR = [
    (1, "Solar power", "https://a.org/x", "web", 2.0, "Solar power turns light into current for homes. It needs clear sun to work at all well. Solar power turns light into current for homes. Solar panels on roofs give current all the day."),
    (2, "Wind", "https://www.nist.gov/w", "official", 1.0, "Wind turns blades in open country all of the day."),
]


def _of(df, column):
    return {r["qid"]: r["x"] for r in df.select("qid", column(F.col("items"), F.col("query")).alias("x")).collect()}


def test_sentences_skip_repeats(spark):
    got = _of(_answers(spark, "solar power current", *SOLAR), W.rank_sentences)
    texts = [(r["id"], r["text"]) for r in got[1]]
    # The best two of the first source (the repeat takes no place), then the other's.
    assert texts == [(1, "Solar power turns light into current for homes."), (1, "Solar panels on roofs give current all the day."), (2, "Wind turns blades in open country all of the day.")]
    assert got[2] == []


def test_short_evidence_gives_its_best_sentence(spark):
    got = _of(_answers(spark, "tides rise", (1, "Sea", "https://a.org", "web", 1.0, "Tides rise twice a day, always. Short."), (2, "B", "https://b.org", "web", 1.0, "Tiny.")), W.extractive_answer)
    assert got[1] == f"{W.HEADER}\n- Tides rise twice a day, always. [1]\n- Tiny. [2]"
    assert got[2] == W.NO_EVIDENCE


def test_pattern_answer(spark):
    rows = [
        (1, "Help", "https://help.openai.com/a", "official", 9.0, "The search model is a fine-tuned version of a model. It rewrites your query into targeted queries."),
        (2, "More", "https://x.org/b", "web", 3.0, "Answers have links to relevant web sources. You choose to search by hand, or it does so on its own."),
    ]
    got = _of(_answers(spark, "How does ChatGPT search work?", *rows), W.extractive_answer)[1].split("\n")
    assert got[0] == W.PATTERN_HEADER and len(got) == 5
    assert got[1] == "- 模型层：The search model is a fine-tuned version of a model. [1]" and got[-1].endswith("[2]")
    assert _of(_answers(spark, "How do other engines work?", *rows), W.extractive_answer)[1].startswith(W.HEADER)


def test_packing_keeps_to_the_budget(spark):
    rows = [(i, "Solar power", "https://a.org/x", "web", 1.0, " ".join(f"Sentence {k} tells of solar power and more, at some length." for k in range(60))) for i in range(1, 21)]
    packed = _of(_answers(spark, "solar", *rows), lambda items, query: W.pack_context(items, query, "fast"))[1]
    sizes = [len(p["packed"]) for p in packed]
    assert max(sizes) <= 780 and 4800 - 220 <= sum(sizes) <= 4800
    assert packed[0]["packed"].startswith("Source context: title=Solar power; domain=a.org; provider=web. Passage: Sentence 0 tells")


def test_selected_sentences_keep_their_order(spark):
    rows = [(1, "Solar", "https://a.org/x", "web", 1.0, "First says little of the matter at hand, truly. Then solar power comes, which the question asks for. Last words end it all here, with no matter left.")]
    got = _of(_answers(spark, "solar power", *rows), lambda items, query: W.select_sentences(query, F.get(items, F.lit(0)), F.lit(110)))[1]
    assert got == "First says little of the matter at hand, truly. Then solar power comes, which the question asks for."


def test_citations(spark):
    rows = _answers(spark, "q", *SOLAR)
    answer = F.lit("# Head\nSolar power turns light into current\nLabel:\n\n| a |")
    assert _of(rows, lambda items, query: W.repair_citations(answer, items, query)) == {1: "# Head\nSolar power turns light into current [1]\nLabel:\n\n| a |", 2: "# Head\nSolar power turns light into current\nLabel:\n\n| a |"}
    assert _of(rows, lambda items, query: W.repair_citations(F.lit("cited [3]"), items, query))[1] == "cited [3]"
    got = one(spark, W.normalize_citations(F.lit("A [1, 9]. B [2][7].\n\nSources: x"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    assert (got["text"], got["used"]) == ("A [1]. B [2].", [1, 2])


def test_primary_citations(spark):
    rows = _answers(spark, "wind blades", *SOLAR)
    answer = F.lit("Wind turns blades in open country [1] [1].\n```\nWind turns blades [1]\n```\nNo mark.")
    got = _of(rows, lambda items, query: W.prefer_primary(answer, items, query))
    assert got[1] == "Wind turns blades in open country [1][2] [1].\n```\nWind turns blades [1]\n```\nNo mark."
    assert got[2].startswith("Wind turns blades in open country [1] [1].")


def test_numbers(spark):
    cases = {
        "$1,200.50": "1200.5", "3/4": "0.75", "abc": "abc", "1000000": "1e6", None: None, "": None, "1/-2": "1/-2", "-1/-2": "-1/-2", "+3/+4": "+3/+4", "+3/4": "0.75", "-1/2": "-0.5", "-0/4": "", "-40/4": "-1", "7/0": "7/0", "0": "0", "-0": "-0", "0.00": "0",
        "007": "7", "12.": "12", ".50": "0.5", "-1,200": "-1.2e3", "100%": "1e2", "40/2": "2", "1.5/2": "1.5/2", "1e5": "1e5", "0.0000001": "1E-7", "0.000001": "0.000001", "1" * 30: "1.111111111111111111111111111e29", "http://a/b": "http://a/b", "-": "-", ".": "",
    }
    df = spark.createDataFrame([(t, x) for t, x in cases.items()], "t string, want string").select("t", "want", N.normalize_number(F.col("t")).alias("x"))
    assert {r["t"]: r["x"] for r in df.collect()} == cases
    boxed = spark.createDataFrame([("so \\boxed{\\frac{1}{2}} and \\boxed 7 end",)], "t string").select(N.boxed_candidates(F.col("t")).alias("x"))
    assert boxed.first()["x"] == ["\\frac{1}{2}", "7"]


def test_trec_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("q1", "d1", 1, 0.5), ("q1", "d2", 2, 0.25), ("q2", "d1", 1, 1.0)], "qid string, did string, rank int, score double")
    files.write_trec(run, str(tmp_path / "run"), "r")
    back = files.read_trec(spark, str(tmp_path / "run"))
    assert sorted(map(tuple, back.select("qid", "did", "rank", "score").collect())) == sorted(map(tuple, run.collect()))
    (tmp_path / "bad").write_text("q1 Q0 d1 1 0.5 r\nq1 Q0 d2 3 0.4 r\n")
    with pytest.raises(Exception, match="ranks are not"):
        files.read_trec(spark, str(tmp_path / "bad")).collect()


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None)], "a long, b string, c string")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "a long, b string, c string").collect() == df.collect()


def test_broken_lines_are_named(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": \n')
    with pytest.raises(ValueError, match=r"a\.jsonl:4"):
        files.read_rows(spark, str(tmp_path / "a.jsonl"), "a long")
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r["a"] for r in files.read_rows(spark, str(tmp_path / "b.jsonl"), "a long", 1).collect()] == [1]
    (tmp_path / "c.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no rows"):
        files.read_rows(spark, str(tmp_path / "c.jsonl"), "a long")


def test_parameters():
    from tessera.functions import params as PA

    assert PA.weight_grid(["a b:1,0,0", "0.5,0.25,0.25"]) == [("a_b", 1.0, 0.0, 0.0), ("d0.5_s0.25_c0.25", 0.5, 0.25, 0.25)]
    assert PA.surface_counts("a=2, b=0") == {"a": 2, "b": 0} and PA.surface_weights("b=3", ["a", "b"]) == {"a": 1.0, "b": 3.0} and PA.surface_list("a,b", ["a", "b"]) == ["a", "b"]
    assert [t[1] for t in PA.reranking_tasks(["zh", "HC3Reranking", "FinEvaReranking"])] == ["FinEvaReranking", "DISCFinLLMReranking", "HC3Reranking"]
    for wrong in (lambda: PA.weight_grid(["x:1,0,0", "x:0,1,0"]), lambda: PA.weights("0,0,0"), lambda: PA.weights("1,-1,0"), lambda: PA.surface_counts("a=1,a=2"), lambda: PA.surface_counts(""), lambda: PA.surface_weights("c=1", ["a"]), lambda: PA.surface_list("z", ["a"])):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(KeyError):
        PA.reranking_tasks("none")


def test_scores_must_cover(spark):
    wanted = spark.createDataFrame([("a", 1), ("b", 2)], "cid string, pos int")
    assert files.check_scores(spark.createDataFrame([("b", 0.2), ("a", 0.1)], "cid string, score double"), wanted).count() == 2
    with pytest.raises(Exception, match="don't match"):
        files.check_scores(spark.createDataFrame([("a", 0.1)], "cid string, score double"), wanted).collect()


def test_xlsx(tmp_path):
    ns = "xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets><sheet name='S'/></sheets></workbook>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>hi</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='C1'><v>2.5</v></c></row></sheetData></worksheet>")
    assert files.read_xlsx(str(tmp_path / "b.xlsx")) == {"S": [["hi", None, 2.5]]}


def test_follow_takes_the_best_next_node(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("a", "c", 15), ("c", "a", 15), ("c", "d", 5), ("c", "e", 5)], "src string, dst string, priority int")
    seeds = spark.createDataFrame([("a",), ("z",)], "seed string")
    got = {}
    for r in G.follow(edges, seeds).orderBy("step").collect():
        got.setdefault(r["seed"], []).append(r["node"])
    assert got == {"a": ["a", "c", "d"], "z": ["z"]}


def _lexical(q: list[str], d: list[str]) -> float:
    shared = set(q) & set(d)
    overlap = sum(min(q.count(t), d.count(t)) for t in shared)
    p, r = overlap / max(len(d), 1), overlap / max(len(q), 1)
    return 2 * p * r / max(p + r, 1e-12) + 0.02 * sum(math.log1p(q.count(t) + d.count(t)) for t in shared if len(t) >= 2)


@pytest.mark.parametrize("block", [4096, 2])
def test_every_pair_is_scored(spark, block):
    q = {0: ["ab", "c", "ab"], 1: ["c"], 7: [], 9: ["zz", "ab"]}
    d = {0: ["ab", "x"], 1: ["ab", "ab", "ab", "c", "c"], 41: [], 42: ["none"], 43: ["zz", "c"]}
    queries, docs = (spark.createDataFrame(list(x.items()), f"{k} long, tokens array<string>") for x, k in ((q, "qid"), (d, "did")))
    rows = L.every_lexical_score(queries, docs, block).collect()
    assert len(rows) == len(q) * len(d)
    assert {(r["qid"], r["did"]): pytest.approx(r["score"]) for r in rows} == {(a, b): _lexical(q[a], d[b]) for a in q for b in d}


def test_features_of_every_pair(spark):
    q = spark.createDataFrame([(3, "alpha beta 市场分析"), (4, "gamma"), (5, None)], "qid long, text string")
    d = spark.createDataFrame([(3, "alpha  beta 市场\nmore 场分 gamma"), (90, ""), (91, "市场分析")], "did long, text string")
    rows = {(r["qid"], r["did"]): r for r in L.feature_columns(q, d).collect()}
    assert len(rows) == 9
    assert rows[3, 3]["title_lexical"] == pytest.approx(_lexical(["alpha", "beta", *"市场分析"], ["alpha"]))
    assert rows[3, 3]["lexical"] == pytest.approx(_lexical(["alpha", "beta", *"市场分析"], ["alpha", "beta", "more", "gamma", *"市场场分"]))
    assert [rows[3, 3][c] for c in ("doc_bigram", "head_bigram", "title_bigram", "title_trigram")] == pytest.approx([2 / 3, 2 / 3, 0, 0])
    assert [rows[3, 91][c] for c in ("doc_bigram", "title_bigram", "title_trigram")] == [1, 1, 1]
    assert rows[4, 3]["lexical"] > 0 and rows[4, 3]["title_lexical"] == 0 and rows[4, 3]["doc_bigram"] == 0
    assert rows[4, 90]["lexical"] == rows[5, 3]["lexical"] == rows[5, 91]["doc_bigram"] == 0


def test_features_cover_every_item_and_document(spark):
    from tessera.plans import all_queries

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/benchmark.parquet").count() * spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all_queries()["h2_feature_columns"](spark, sf).select("qid", "did").distinct().count() == n


def test_late_interaction_searches_all_vectors(spark):
    v = {i: [math.cos(i * j + 1) for j in range(6)] for i in range(30)}
    e = spark.createDataFrame(list(v.items()), "did long, v array<double>")
    got = R.late_interaction_top_k(e.where("did % 10 = 0").withColumnRenamed("did", "qid"), e, 3, 2, block=2).collect()
    cut = {i: [x[j : j + 2] for j in (0, 2, 4)] for i, x in v.items()}
    score = lambda q, d: sum(max(a[0] * b[0] + a[1] * b[1] for b in cut[d]) for a in cut[q][1:]) / 2
    want = {(q, d): score(q, d) for q in (0, 10, 20) for d in sorted(set(v) - {q}, key=lambda d: (-round(score(q, d), 8), d))[:3]}
    assert {(r["qid"], r["did"]): r["score"] for r in got} == pytest.approx(want)


def test_queries_see_the_whole_text(spark, tmp_path):
    """Words behind the first 60 characters count, and texts that differ only there have different keys."""
    import hashlib
    import json

    from tessera.plans import all_queries

    lead = 'say "x" \\ ' + "plain " * 12
    texts = {14: lead + "compare a versus b today", 20: lead, 27: lead + "end", 34: lead + "versus latest"}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {n: {r["item_id"]: r for r in all_queries()[n](spark, str(tmp_path)).collect()} for n in ("t7_intent_tags", "f6_f9_query_plan", "f10_rewrite_queries", "f13_research_steps", "f16_f17_request_keys")}
    assert "compare" in got["t7_intent_tags"][34]["tags"] and "compare" not in got["t7_intent_tags"][20]["tags"]
    assert got["f6_f9_query_plan"][34]["needs_freshness"] and not got["f6_f9_query_plan"][27]["needs_freshness"]
    assert " ".join(texts[27].split()) in got["f10_rewrite_queries"][27]["queries"]
    assert "freshness" in got["f13_research_steps"][34]["steps"] and "freshness" not in got["f13_research_steps"][27]["steps"]
    asked = {i: {0: "latest ", 1: "in 2026 "}.get(i % 5, "") + t for i, t in texts.items()}
    key = lambda q: hashlib.sha256(json.dumps({"lens": "web", "mode": "fast", "query": q}, separators=(",", ":")).encode()).hexdigest()
    assert {i: r["key"] for i, r in got["f16_f17_request_keys"].items()} == {i: key(q) for i, q in asked.items()}
    assert got["f16_f17_request_keys"][34]["fresh"] and got["f16_f17_request_keys"][34]["ttl"] == 300 and not got["f16_f17_request_keys"][27]["fresh"]


def test_every_order_and_request_counts(spark):
    from tessera.plans import all_queries

    sf = "/root/testdata/sf0.001"
    orders = {r["o_orderkey"]: r["o_custkey"] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey").collect()}
    got = {r["o_orderkey"]: r["number"] for r in all_queries()["t35_normalize_number"](spark, sf).collect()}
    assert len(got) == len(orders)
    tens = {k: c for k, c in orders.items() if c % 10 == 0 and k % 12 == 0}
    assert any(tens.values()) and all(("e" in got[k]) == (c > 0) and float(got[k]) == c for k, c in tens.items())
    assert {r["rid"] for r in all_queries()["j11_exact_matches"](spark, sf).collect()} >= {r["item_id"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id * 200 <= 3600").collect()}

