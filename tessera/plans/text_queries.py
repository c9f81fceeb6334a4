"""Queries of text and URL functions over documents, benchmark and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.plans.registry import listed, query, sql_clean, sql_domain, sql_fingerprint, sql_keywords, sql_support_tokens, sql_tokens, table


def _digest(tokens) -> F.Column:
    return F.md5(F.array_join(F.array_sort(tokens), " "))


@query(f"SELECT doc_id, md5({sql_clean('text')}) AS cleaned, length({sql_clean('text')})::BIGINT AS n FROM documents")
def t1_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("c", T.clean_text(F.col("text")))
    return docs.select("doc_id", F.md5("c").alias("cleaned"), F.length("c").cast("long").alias("n"))


@query(f"SELECT doc_id, len({sql_tokens('text')})::BIGINT AS n_tokens, md5(array_to_string(list_sort({sql_tokens('text')}), ' ')) AS tokens FROM documents")
def t2_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("t", T.tokenize(F.col("text")))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), _digest(F.col("t")).alias("tokens"))


_GRAMS = "list_transform(list_filter(list_transform(range(1, len(w) - {k} + 2), lambda i: w[i : i + {k} - 1]), lambda g: len(list_filter(g, lambda x: x NOT IN ({stop}))) > 0), lambda g: array_to_string(g, ' '))"


@query(
    r"WITH q AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_\-]{1,}') AS w FROM benchmark)"
    f" SELECT item_id, array_to_string(list_concat({_GRAMS.format(k=3, stop=listed(T.RANK_STOPWORDS))}, {_GRAMS.format(k=2, stop=listed(T.RANK_STOPWORDS))}), '|') AS phrases FROM q"
)
def t3_query_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_phrases(F.col("text")), "|").alias("phrases"))


@query(f"SELECT item_id, array_to_string({sql_keywords('text')}[1:9], ' ') AS keyword_query FROM benchmark")
def t4_keyword_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.keyword_query(F.col("text")).alias("keyword_query"))


_NORMAL = r"trim(regexp_replace(lower(trim(text)), '[^\p{L}\p{N}_]+', ' ', 'g'))"


@query(f"SELECT item_id, {_NORMAL} AS normalized FROM benchmark")
def t5_normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.normalize_query(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, md5(array_to_string(list_sort({sql_fingerprint(_NORMAL)}), ' ')) AS tokens FROM documents")
def t6_fingerprint_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _digest(T.fingerprint_tokens(T.normalize_query(F.col("text")))).alias("tokens"))


_QUESTION = "CASE item_id % 7 WHEN 0 THEN 'compare ' WHEN 1 THEN 'how to use ' WHEN 2 THEN 'why ' WHEN 3 THEN 'best API for ' WHEN 4 THEN 'latest news: ' WHEN 5 THEN 'comprehensive legal ' ELSE '' END || text"
_ASCII_INTENTS = {t: p.split("|比较")[0].split("|怎么")[0].split("|为什么")[0].split("|推荐")[0].split("|代码")[0] for t, p in T.INTENTS.items()}
_TAGS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(q, '(?i){p}') THEN '{t}' END" for t, p in _ASCII_INTENTS.items()) + "], lambda t: t IS NOT NULL)"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.expr(_QUESTION).alias("q"))


@query(f"SELECT item_id, CASE WHEN len({_TAGS}) > 0 THEN array_to_string({_TAGS}, ',') ELSE 'lookup' END AS tags FROM (SELECT item_id, {_QUESTION} AS q FROM benchmark)")
def t7_intent_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("item_id", F.array_join(T.intent_tags(F.col("q")), ",").alias("tags"))


@query(
    rf"""
WITH RECURSIVE s AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({sql_clean('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents
), fold AS (
  SELECT doc_id, s, 1 AS i, ''::VARCHAR AS now, []::VARCHAR[] AS done FROM s WHERE len(s) > 0
  UNION ALL
  SELECT doc_id, s, i + 1,
    CASE WHEN length(now) + length(s[i]) + 1 <= 900 THEN trim(now || ' ' || s[i]) ELSE s[i] END,
    CASE WHEN length(now) + length(s[i]) + 1 <= 900 OR now = '' THEN done ELSE list_append(done, now) END
  FROM fold WHERE i <= len(s)
), packed AS (
  SELECT doc_id, list_append(done, now) AS p FROM fold WHERE i = len(s) + 1
), cut AS (
  SELECT doc_id, CASE WHEN len(p) = 1 AND length(p[1]) > 1350 THEN list_transform(range(1, length(p[1]) + 1, 900), lambda i: substr(p[1], i, 900)) ELSE p END AS p FROM packed
), each AS (
  SELECT doc_id, unnest(p) AS passage, unnest(range(len(p))) AS pos FROM cut
)
SELECT doc_id, pos::BIGINT AS pos, md5(passage) AS passage FROM each
"""
)
def t9_split_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("clean", T.clean_text(F.col("text")))
    each = docs.select("doc_id", F.posexplode(T.split_passages(F.col("clean"))).alias("pos", "passage"))
    return each.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("passage").alias("passage"))


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(f"SELECT page_id, 'Source title: ' || {_TITLE} || '. Source domain: ' || {sql_domain('url')} || CASE WHEN page_id % 2 = 0 THEN '. Source snippet: s' ELSE '' END || '. body' AS passage FROM pages")
def t10_contextual_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumns({"title": F.regexp_extract("html", "<title>([^<]*)</title>", 1), "snippet": F.when(F.col("page_id") % 2 == 0, "s").otherwise("")})
    return pages.select("page_id", T.contextual_passage(F.col("title"), U.domain_of(F.col("url")), F.col("snippet"), F.lit("body")).alias("passage"))


_VARIANT = "CASE page_id % 6 WHEN 0 THEN ' ' || upper(url) || ' ' WHEN 1 THEN replace(url, 'http://', 'www.') WHEN 2 THEN replace(url, 'http://', '') WHEN 3 THEN '.edu' WHEN 4 THEN 'not a domain' ELSE replace(url, '.com/', '.com:8080/') END"
_HOST = r"regexp_replace(split_part(regexp_extract(CASE WHEN contains(v, '://') THEN v ELSE 'https://' || v END, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), ':', 1), '^www\.', '')"


@query(
    rf"SELECT page_id, CASE WHEN regexp_full_match(v, '\.[a-z]{{2,}}') THEN v WHEN regexp_full_match({_HOST}, '[a-z0-9.-]+\.[a-z]{{2,}}') THEN {_HOST} ELSE '' END AS domain FROM (SELECT page_id, lower(trim({_VARIANT})) AS v FROM pages)"
)
def t11_clean_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.clean_domain(F.expr(_VARIANT)).alias("domain"))


@query(f"SELECT page_id, {sql_domain('url')} AS domain, regexp_replace(split_part(url || '//#top', '#', 1), '/+$', '') AS canonical FROM pages")
def t12_t13_domain_and_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.domain_of(url).alias("domain"), U.canonical_url(F.concat(url, F.lit("//#top"))).alias("canonical"))


_ODD = "CASE page_id % 5 WHEN 0 THEN url || '&ad_domain=x' WHEN 1 THEN 'https://duckduckgo.com/y.js?u=1' WHEN 2 THEN url || '/a.PDF' WHEN 3 THEN 'http://h.com/pic.JPG' ELSE url END"


@query(
    rf"SELECT page_id, (CASE WHEN page_id % 5 = 1 THEN true ELSE regexp_matches(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), 'ad_domain=|ad_provider=') END) AS noise, NOT regexp_matches(lower(u), '\.({'|'.join(U.UNFETCHED)})$') AS fetched FROM (SELECT page_id, {_ODD} AS u FROM pages)"
)
def t14_t15_noise_and_fetchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.expr(_ODD)
    return table(spark, sf_dir, "pages").select("page_id", U.is_noise(u).alias("noise"), U.should_fetch(u).alias("fetched"))


_STATUS = "CASE page_id % 9 WHEN 0 THEN 404 WHEN 1 THEN NULL ELSE 200 END"
_BODY = "CASE WHEN page_id % 4 = 0 THEN 'Just a moment' ELSE html END"


@query(f"SELECT page_id, coalesce({_STATUS} >= 400, false) OR regexp_matches(lower({_TITLE} || ' ' || substr({_BODY}, 1, 800)), '{'|'.join(U.BLOCKED_MARKERS)}') AS blocked FROM pages")
def t16_blocked_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.looks_blocked(F.expr(_STATUS), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.expr(_BODY)).alias("blocked"))


_HREF = (
    "CASE page_id % 4 WHEN 0 THEN '//duckduckgo.com/l/?uddg=' || replace(replace(url, ':', '%3A'), '/', '%2F')"
    " WHEN 1 THEN 'https://www.bing.com/ck/a?x=1&u=a1' || rtrim(translate({b64}, '+/', '-_'), '=')"
    " WHEN 2 THEN 'https://r.search.yahoo.com/_ylt=1/RU=' || replace(replace(url, ':', '%3A'), '/', '%2f') || '/RK=2' ELSE url END"
)


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^[^&#]*') WHEN 2 THEN regexp_extract(url, '^[^?#]*') ELSE url END AS target FROM pages")
def t17_decode_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.expr(_HREF.format(b64="replace(replace(base64(cast(url as binary)), '\r\n', ''), '=', '')").replace("rtrim(", "rtrim('=', ").replace(", '=')", ")"))
    return table(spark, sf_dir, "pages").select("page_id", U.decode_redirect(href).alias("target"))


_CODE = r"regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|\d+|==|!=|<=|>=|[-+*/%]=?|[{}()\[\].,;:]')"
_CAMEL = r"list_filter(list_transform(string_split(replace(regexp_replace(t, '([a-z0-9])([A-Z])', '\1' || chr(1) || '\2', 'g'), '_', chr(1)), chr(1)), lambda p: lower(p)), lambda p: p <> '')"


@query(
    rf"SELECT doc_id, len(k)::BIGINT AS n, md5(array_to_string(k, ' ')) AS tokens FROM (SELECT doc_id, flatten(list_transform({_CODE}, lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z_]') THEN list_concat([lower(t)], {_CAMEL}) ELSE [lower(t)] END)) AS k FROM documents)"
)
def t19_code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("k", T.code_tokens(F.col("text")))
    return docs.select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", " ")).alias("tokens"))


@query(r"SELECT doc_id, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9_.%+-]+'), ' ')) AS tokens FROM documents")
def t20_rerank_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(T.rerank_tokens(F.col("text")), " ")).alias("tokens"))


@query("SELECT doc_id, substr(string_split(string_split(trim(text, chr(10) || ' '), chr(10))[1], '  ')[1], 1, 96) AS title, substr(replace(trim(text, chr(10) || ' '), chr(10), ' '), 1, 192) AS head FROM documents")
def t21_title_and_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.title_text(F.col("text")).alias("title"), T.head_text(F.col("text")).alias("head"))


_CN = "CASE WHEN item_id % 3 = 0 THEN '金融市场分析' ELSE '市场' END"
_CD = "CASE WHEN item_id % 2 = 0 THEN '分析金融市场' ELSE '股票市场报告' END"
_GRAM2 = "list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)))"


@query(f"SELECT item_id, round(len(list_intersect({_GRAM2.format(x='q')}, {_GRAM2.format(x='d')})) / len({_GRAM2.format(x='q')})::DOUBLE, 6) AS recall FROM (SELECT item_id, {_CN} AS q, {_CD} AS d FROM benchmark)")
def t22_cjk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(T.cjk_recall(F.expr(_CN), F.expr(_CD), 2), 6).alias("recall"))


@query(f"SELECT page_id, {sql_clean('prefix')} AS prefix FROM (SELECT page_id, 'Source context: title=' || {_TITLE} || '; domain=' || {sql_domain('url')} || '; provider=web. Passage:' AS prefix FROM pages)")
def t23_source_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.source_prefix(F.regexp_extract("html", "<title>([^<]*)</title>", 1), U.domain_of(F.col("url")), F.lit("web")).alias("prefix"))


@query(f"SELECT doc_id, len({sql_support_tokens('text')})::BIGINT AS n, md5(array_to_string({sql_support_tokens('text')}, ' ')) AS tokens FROM documents")
def t27_support_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("t", T.support_tokens(F.col("text")))
    return docs.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


_MIXED = "CASE item_id % 7 WHEN 0 THEN '什么' || text WHEN 1 THEN text || ' 检索' WHEN 2 THEN 'かな ' || text WHEN 3 THEN '㐀' WHEN 4 THEN '鿿?' WHEN 5 THEN 'ㄱ' ELSE text END"


@query(f"SELECT item_id, CASE WHEN regexp_matches(q, '[\\x{{3400}}-\\x{{9fff}}]') THEN 'Chinese' ELSE 'the same language as the user query' END AS language FROM (SELECT item_id, {_MIXED} AS q FROM benchmark)")
def t28_answer_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.answer_language(F.expr(_MIXED)).alias("language"))


_TIER_SQL = "CASE " + "".join(
    f"WHEN regexp_matches(d, '(^|\\.)({'|'.join(x.replace('.', chr(92) + '.') for x in U.TIERS[t])})$')" + (f" OR regexp_matches(d, '({'|'.join(x.replace('.', chr(92) + '.') for x in U.TRUSTED_SUFFIXES)})$')" if t == "government" else "") + f" THEN '{t}' "
    for t in ("low_signal", "government", "academic", "standards", "official_docs", "medical", "news_wire", "reference")
) + "ELSE 'general' END"
_TIER_URL = (
    "CASE page_id % 10 WHEN 0 THEN 'https://www.nih.gov/a' WHEN 1 THEN 'https://x.reddit.com/b' WHEN 2 THEN 'https://arxiv.org/c' WHEN 3 THEN 'https://a.mit.edu'"
    " WHEN 4 THEN 'https://docs.python.org/3' WHEN 5 THEN 'http://mayoclinic.org' WHEN 6 THEN 'https://owasp.org/x' WHEN 7 THEN 'https://en.wikipedia.org/w' WHEN 8 THEN 'http://www.bbc.co.uk/n' ELSE url END"
)
_WEIGHT_SQL = "CASE tier " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in U.TIER_WEIGHTS.items()) + " END::DOUBLE"


@query(f"SELECT page_id, tier, {_WEIGHT_SQL} AS quality, tier IN ({listed(U.PRIMARY_TIERS)}) OR page_id % 2 = 0 AS is_primary FROM (SELECT page_id, {_TIER_SQL} AS tier FROM (SELECT page_id, {sql_domain(_TIER_URL)} AS d FROM pages))")
def f4_f5_trust_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.expr(_TIER_URL)
    provider = F.when(F.col("page_id") % 2 == 0, "official").otherwise("web")
    return table(spark, sf_dir, "pages").select("page_id", U.trust_tier(url).alias("tier"), U.source_quality(url).alias("quality"), U.is_primary(url, provider).alias("is_primary"))


@query(
    f"SELECT page_id, d <> '' AND (d = 'ththre.example.com' OR d LIKE '%.example.com' OR d LIKE '%.edu') AND NOT (d = 'a.mit.edu' OR d LIKE '%.a.mit.edu') AS allowed FROM (SELECT page_id, {sql_domain(_TIER_URL)} AS d FROM pages)"
)
def f2_f3_url_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    include, exclude = F.array(F.lit("example.com"), F.lit(".edu")), F.array(F.lit("a.mit.edu"))
    return table(spark, sf_dir, "pages").select("page_id", U.url_allowed(F.expr(_TIER_URL), include, exclude).alias("allowed"))
