"""Queries of search requests, result pages, fetched pages and answer texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import authority as AU
from tessera.functions import html_text as H
from tessera.functions import planning as P
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import answers as W
from tessera.operators import claims as C
from tessera.operators.evidence import sandwich
from tessera.plans.evidence_queries import _ANSWER, _EV, _EV_TIER, _evidence
from tessera.plans.registry import query, sql_clean, sql_domain, sql_keywords, sql_tokens, table

# The benchmark's texts behind subjects that the rules know, years, and none.
_SUBJECTS = [
    "how to set the Chrome default search engine:", "chrome tabs on a mac:", "Git undo last commit on Windows:", "git rebase or merge, digital:", "python pandas numpy random seed:", "fastapi in docker compose env:",
    "GitHub Actions cache for pnpm:", "npm global install:", "pnpm workspaces:", "aws s3 presigned url:", "postgres create index concurrently:", "react useEffect typescript:", "oauth pkce:", "dns cname record:",
    "robots.txt disallow crawler sitemap:", "wcag contrast:", "nist password, OWASP broken access:", "mitre irs tax tsa:", "credit freeze ftc:", "mortgage escrow:", "federal funds cpi inflation:", "sec 10-K, 10k:",
    "fda caffeine nih vitamin deficiency:", "cdc blood pressure apa mla:", "northern lights aurora:", "why is the sky blue:", "earthquake magnitude intensity hurricane:", "ragas perplexity api citations:", "deepseek api thinking:",
    "latest ChatGPT search:", "OpenAI web search in 2026:", "Columbus county:", "contextual retrieval llmlingua:", "trusted source e-e-a-t:", "what is known:", "current state in 1999:", "",
]
_ASKED_SQL = "[" + ", ".join(f"'{s}'" for s in _SUBJECTS) + f"][(item_id % {len(_SUBJECTS)} + 1)::INT] || ' ' || text"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.element_at(F.array(*map(F.lit, _SUBJECTS)), (F.col("item_id") % len(_SUBJECTS) + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.collapse_space(F.concat_ws(" ", subject, "text")).alias("q"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _authority_sql() -> str:
    parts = []
    for rule, then in AU.authority_rules():
        before, mark, after = then.partition("{}")
        parts.append(f"CASE WHEN {AU.sql_holds('lower(q)', rule)} THEN {f'{_q(before)} || kw || {_q(after)}' if mark else _q(then)} END")
    return "[" + ", ".join(parts) + "]"


_ASKED = f"WITH asked AS (SELECT item_id, {sql_clean(_ASKED_SQL)} AS q FROM benchmark), k AS (SELECT item_id, q, array_to_string({sql_keywords('q')}[1:9], ' ') AS kw FROM asked)"


@query(_ASKED + f" SELECT item_id, array_to_string(list_filter({_authority_sql()}, lambda x: x IS NOT NULL), '|') AS queries FROM k")
def f11_authority_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("item_id", F.array_join(AU.authority_queries(F.col("q")), "|").alias("queries"))


_SEEDS_SQL = "[" + ", ".join(f"CASE WHEN {AU.sql_holds('lower(q)', rule)} THEN {_q('||'.join(found))} END" for rule, found in AU.seed_rules()) + "]"


@query(_ASKED + f", s AS (SELECT item_id, list_filter({_SEEDS_SQL}, lambda x: x IS NOT NULL) AS s FROM k) SELECT item_id, unnest(s) AS seed, unnest(range(len(s)))::INT AS pos FROM s")
def f12_seed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _asked(spark, sf_dir).select("item_id", F.posexplode(AU.seed_results(F.col("q"))).alias("pos", "s"))
    return found.select("item_id", F.concat_ws("||", "s.title", "s.url", "s.snippet", "s.provider").alias("seed"), "pos")


def _rewritten_sql(deep: bool, lens: str) -> str:
    lenses = [f"{_q(t.split('{}')[0])} || q || {_q(t.split('{}')[1])}" for t in P.LENSES[lens]]
    sites = P.PROVIDER_SITES + (P.PROVIDER_SITES_DEEPER if deep else [])
    first = [f"CASE WHEN regexp_matches(q, '(?i){P.PROVIDER}') THEN 'site:{d} ' || q END" for d in sites] + lenses + ["'site:a.com ' || q", "q", "CASE WHEN kw <> '' AND lower(kw) <> lower(q) THEN kw END"]
    last = [r"CASE WHEN regexp_matches(q, '(?i)latest|today|current|now|recent|new') AND NOT regexp_matches(q, '\b20\d{2}\b') THEN q || ' 2026' END"] + (["q || ' official source'", "q || ' explained'"] if deep else [])
    every = f"list_concat([{', '.join(first)}], {_authority_sql()}, [{', '.join(last)}])"
    return _ASKED + f", l AS (SELECT item_id, list_transform(list_filter({every}, lambda x: x IS NOT NULL), lambda x: x || ' -site:b.com') AS l FROM k) SELECT item_id, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)[1:{5 if deep else 3}], '|') AS queries FROM l"


@query(_rewritten_sql(True, "web"))
def f10_rewrite_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("item_id", F.array_join(P.rewrite_queries(F.col("q"), "deep", "web", ["a.com"], ["b.com"]), "|").alias("queries"))


@query(_rewritten_sql(False, "finance"))
def f10_rewrite_queries_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("item_id", F.array_join(P.rewrite_queries(F.col("q"), "fast", "finance", ["a.com"], ["b.com"]), "|").alias("queries"))


_RAW = "['HTTPS://WWW.A' || item_id % 3 || '.com/x', 'b.org:80', '.Edu', 'bad domain', 'c' || item_id || '.net', 'b.org']"


@query(
    f"""WITH r AS (SELECT item_id, list_distinct(list_filter(list_transform({_RAW}, lambda x: CASE lower(x) WHEN '.edu' THEN '.edu' WHEN 'bad domain' THEN '' ELSE regexp_replace(regexp_replace(lower(x), '^https?://(www\\.)?', ''), '[/:].*$', '') END), lambda x: x <> '')) AS d FROM benchmark)
SELECT item_id, array_to_string(list_sort(list_filter(d, lambda x: x <> 'b.org' OR item_id % 2 = 0)), ',') AS include, CASE WHEN item_id % 4 = 3 THEN 'any' ELSE ['day', 'week', 'month'][(item_id % 4 + 1)::INT] END AS recency, ['us', 'de', ''][(item_id % 3 + 1)::INT] AS country, ['en', 'fr'][(item_id % 2 + 1)::INT] AS language, CASE WHEN item_id % 5 < 3 THEN ['web', 'academic', 'news'][(item_id % 5 + 1)::INT] ELSE 'web' END AS lens FROM r"""
)
def f1_search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("array(concat('HTTPS://WWW.A', item_id % 3, '.com/x'), 'b.org:80', '.Edu', 'bad domain', concat('c', item_id, '.net'), 'b.org')")
    one = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (F.col("item_id") % n + 1).cast("int"))
    exclude = F.when(F.col("item_id") % 2 == 1, F.array(F.lit("http://B.org/"))).otherwise(F.array().cast("array<string>"))
    f = P.search_filters(raw, exclude, one(4, " Day", "week", "MONTH", "decade"), one(3, "U.S.A", "de-DE", "1"), one(2, "EN_us", "fr"), one(5, "web", "Academic ", "news", "blogs", ""))
    return table(spark, sf_dir, "benchmark").select("item_id", f.alias("f")).select("item_id", F.array_join(F.array_sort("f.include_domains"), ",").alias("include"), "f.recency", "f.country", "f.language", "f.lens")


# Result pages of three engines, ten pages a result page; every seventh result has no link that is a web address.
_SERP = """
WITH r AS (SELECT page_id, page_id // 10 AS g, ['duckduckgo', 'bing', 'yahoo'][(page_id // 10 % 3 + 1)::INT] AS engine, CASE WHEN page_id % 7 = 0 THEN 'ftp://x/' || page_id ELSE regexp_extract(url, '^[^?#]*') END AS target FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY page_id) AS rank FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY page_id) AS kept FROM n WHERE target LIKE 'http%')"""


@query(_SERP + " SELECT g, engine AS provider, 'Title & ' || page_id AS title, target AS url, CASE engine WHEN 'yahoo' THEN 'Title & ' || page_id || ' about ' || page_id ELSE 'about ' || page_id END AS snippet, rank::INT AS rank FROM k WHERE kept <= 5")
def t18_result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("target", F.expr("CASE WHEN page_id % 7 = 0 THEN concat('ftp://x/', page_id) ELSE regexp_extract(url, '^[^?#]*', 0) END"))
    block = F.expr("""CASE page_id div 10 % 3
      WHEN 0 THEN concat('<div class="x result"><a class="result__a" href="//duckduckgo.com/l/?uddg=', url_encode(target), '">Title &amp; <b>', page_id, '</b></a><p class="result__snippet"> about\n ', page_id, '</p></div>')
      WHEN 1 THEN concat('<li class="b_algo"><p>no</p><h2><a href="', target, '">Title &amp; ', page_id, '</a></h2><div class="b_caption"><p>about ', page_id, '</p></div></li>')
      ELSE concat('<div data-yga="1"><div class="a compTitle"><a href="https://r.search.yahoo.com/RU=', url_encode(target), '/RK=2">Title &amp; ', page_id, '</a></div><p>about ', page_id, '</p></div>') END""")
    serp = pages.select(F.expr("page_id div 10").alias("g"), F.struct("page_id", block.alias("block")).alias("b")).groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "").alias("html"))
    engine = F.element_at(F.array(F.lit("duckduckgo"), F.lit("bing"), F.lit("yahoo")), (F.col("g") % 3 + 1).cast("int"))
    return H.search_results(serp.withColumn("engine", engine), 5).select("g", "provider", "title", "url", "snippet", "rank")


# Two results for each second page; some pages are plain text, refused, blocked or of a kind that isn't fetched.
_FETCH = "CASE page_id % 6 WHEN 1 THEN 'https://h.org/' || page_id || '.pdf' WHEN 2 THEN 'https://h.org/' || page_id || '.zip' ELSE 'https://h.org/' || page_id END"


@query(
    f"""WITH r AS (SELECT page_id, {_FETCH} AS url, page_id % 6 AS kind, k FROM pages, (SELECT unnest([1, 2]) AS k)),
d AS (SELECT *, kind IN (0, 1, 3, 4) AS there FROM r)
SELECT page_id, k, url, CASE WHEN kind = 0 THEN 'Page ' || page_id ELSE 'result ' || page_id END AS title, CASE WHEN kind = 0 THEN 'Page ' || page_id || ' ' || repeat('word ', 79) || 'word' WHEN kind = 1 THEN 'plain text ' || page_id ELSE 'snippet ' || k END AS text, CASE kind WHEN 3 THEN 404 WHEN 5 THEN NULL WHEN 2 THEN NULL ELSE 200 END AS status, there AS fetched FROM d"""
)
def s20_fetched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds: HTML, plain text, not fetched, refused, blocked, not there."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(_FETCH.replace("||", "||")).alias("url"), (F.col("page_id") % 6).alias("kind"))
    word = F.repeat(F.lit("word "), F.lit(80))
    body = (
        F.when(F.col("kind") == 0, F.concat(F.lit("<html><title>Page "), F.col("page_id"), F.lit("</title><nav>menu</nav><body>Page "), F.col("page_id"), F.lit(" "), word, F.lit("</body>")))
        .when(F.col("kind") == 1, F.concat(F.lit("plain \n text "), F.col("page_id")))
        .when(F.col("kind") == 4, F.lit("<p>Just a moment</p>"))
        .otherwise("gone")
    )
    store = pages.where("kind != 5").select("url", F.when(F.col("kind") == 3, 404).otherwise(200).alias("status"), F.when(F.col("kind") == 1, "text/plain").otherwise("Text/HTML; charset=utf-8").alias("content_type"), body.alias("body"))
    results = pages.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).select("page_id", "k", "url", F.concat(F.lit("result "), F.col("page_id")).alias("title"), F.concat(F.lit("snippet "), F.col("k")).alias("snippet"), F.lit("web").alias("provider"))
    return H.fetched_documents(results, store).select("page_id", "k", "url", "title", "text", "status", "fetched")


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, ev = _evidence(spark, sf_dir)
    return W.gathered(q.withColumnRenamed("text", "query"), ev)


@query()
def w15_w16_pack_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, ev = _evidence(spark, sf_dir)
    rows = W.gathered(q.withColumnRenamed("text", "query"), sandwich(ev), "place")
    packed = rows.withColumn("packed", W.pack_context(F.col("items"), F.col("query"), "fast"))
    packed = packed.select("qid", "packed", W.packed_meta(F.col("items"), F.col("packed"), "fast").alias("meta"))
    return packed.select("qid", F.posexplode("packed").alias("pos", "p"), "meta").select("qid", "pos", "p.id", "p.packed", "meta.packed_chars", "meta.compression_ratio")


@query()
def w17_x1_extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).select("qid", W.extractive_answer(F.col("items"), F.col("query")).alias("answer"))


_BEST = (
    _EV
    + f""", w AS (SELECT qid, id, score, provider, list_distinct({sql_tokens("title || ' ' || passage")}) AS words FROM ev),
lines AS (SELECT qid, id AS answer, unnest(string_split(passage, chr(10))) AS line, unnest(range(len(string_split(passage, chr(10))))) AS line_no FROM ev),
t AS (SELECT *, list_distinct({sql_tokens('line')}) AS own FROM lines),
s AS (SELECT t.qid, answer, line_no, any_value(line) AS line, arg_min(w.id, (-round(CASE WHEN len(own) = 0 THEN 0 ELSE len(list_intersect(own, words)) / len(own)::DOUBLE + 0.01::DOUBLE * least(score, 10) + CASE WHEN provider = 'official' THEN 0.03 ELSE 0 END::DOUBLE END, 12), w.id)) AS best FROM t JOIN w USING (qid) GROUP BY ALL)"""
)


@query(_BEST + " SELECT qid, answer, line_no::INT AS line_no, best FROM s")
def w18_best_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every user turn with the turn of its conversation that supports it best."""
    q, ev = _evidence(spark, sf_dir)
    lines = ev.select("qid", F.col("id").alias("answer"), F.posexplode(F.split("passage", "\n")).alias("line_no", "line"))
    return lines.join(_answered(spark, sf_dir), "qid").select("qid", "answer", "line_no", W.best_citation(F.col("line"), F.col("items")).alias("best"))


@query(_BEST + f" SELECT qid, answer, string_agg(CASE WHEN trim(line) = '' OR (length(trim(line)) < 24 AND trim(line) LIKE '%:') THEN line ELSE rtrim(line) || ' [' || best || ']' END, chr(10) ORDER BY line_no) AS repaired FROM s GROUP BY qid, answer")
def x2_repaired_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, ev = _evidence(spark, sf_dir)
    texts = ev.select("qid", F.col("id").alias("answer"), "passage")
    return texts.join(_answered(spark, sf_dir), "qid").select("qid", "answer", W.repair_citations(F.col("passage"), F.col("items"), F.col("query")).alias("repaired"))


_CITED = r"regexp_extract_all(text, '\[(\d+(?:\s*,\s*\d+)*)\]', 1)"


@query(
    f"""WITH a AS (SELECT conv_id, turn, trim(regexp_replace({_ANSWER} || chr(10) || 'Sources: [1] x', '(?is)\\n+\\s*sources\\s*:.*$', '')) AS text FROM conversations WHERE role = 'assistant'),
g AS (SELECT *, list_transform({_CITED}, lambda x: list_filter(list_transform(string_split(x, ','), lambda y: trim(y)::BIGINT), lambda y: y IN (1, 3))) AS ids, string_split_regex(text, '\\[\\d+(?:\\s*,\\s*\\d+)*\\]') AS parts FROM a)
SELECT conv_id, turn, array_to_string(list_transform(parts, lambda p, i: p || coalesce(array_to_string(list_transform(ids[i], lambda y: '[' || y || ']'), ''), '')), '') AS text, array_to_string(list_filter(flatten(ids), lambda x, i: list_position(flatten(ids), x) = i), ',') AS used FROM g"""
)
def x4_normalized_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    valid = F.array(F.lit(1).cast("long"), F.lit(3).cast("long"))
    answer = F.concat(F.expr(_ANSWER), F.lit("\nSources: [1] x"))
    return c.select("conv_id", "turn", W.normalize_citations(answer, valid).alias("n")).select("conv_id", "turn", "n.text", F.array_join("n.used", ",").alias("used"))


@query()
def x3_primary_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as answers that cite the first evidence in every line."""
    q, ev = _evidence(spark, sf_dir)
    first = ev.groupBy("qid").agg(F.min("id").alias("first"))
    texts = ev.join(first, "qid").select("qid", F.col("id").alias("answer"), F.regexp_replace("passage", F.lit("(?m)$"), F.concat(F.lit(" ["), F.col("first").cast("string"), F.lit("]"))).alias("cited"))
    return texts.join(_answered(spark, sf_dir), "qid").select("qid", "answer", W.prefer_primary(F.col("cited"), F.col("items"), F.col("query")).alias("preferred"))


_DOMAIN = sql_domain("url")


@query(
    _EV
    + _EV_TIER
    + f" SELECT qid, string_agg('[' || id || '] ' || title || chr(10) || 'URL: ' || url || chr(10) || 'SOURCE TYPE: ' || tier || '; PRIORITY: ' || CASE WHEN tier IN ({', '.join(_q(t) for t in U.PRIMARY_TIERS)}) OR provider = 'official' THEN 'primary' ELSE 'supporting' END || chr(10) || 'PASSAGE: ' || substr(passage, 1, 650), chr(10) || chr(10) ORDER BY id) AS block FROM t GROUP BY qid"
)
def t29_evidence_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).select("qid", W.evidence_block(F.col("items"), 650).alias("block"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag <> 'N' OR round(l_discount * 5, 6) < 0.34 AS judge FROM lineitem")
def f15_needs_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as checked claims: those not returned are supported, with a score of five times the discount."""
    rows = table(spark, sf_dir, "lineitem").withColumn("status", F.when(F.col("l_returnflag") == "N", "supported").otherwise("weak")).withColumn("support", F.round(F.col("l_discount") * 5, 6))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.needs_judge(F.col("status"), F.col("support")).alias("judge"))
