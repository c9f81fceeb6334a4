"""Queries of evidence ranking, planning, claims and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import planning as P
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import claims as C
from tessera.operators import evidence as E
from tessera.plans.registry import SQL, query, sql_domain, sql_keywords, sql_support_tokens, sql_tokens, table
from tessera.plans.text_queries import _GRAMS, _TIER_SQL, _WEIGHT_SQL, listed

_URL = "CASE WHEN doc_id % 7 = 0 THEN 'https://arxiv.org/abs/' WHEN doc_id % 11 = 0 THEN 'https://www.reddit.com/r/' ELSE 'http://' || source || '.example.com/' END || doc_id"
_PROVIDER = "CASE WHEN doc_id % 10 = 0 THEN 'official' ELSE 'web' END"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("did"), T.title_text(F.col("text")).alias("title"), F.expr(_URL).alias("url"), F.lit("").alias("snippet"), F.expr(_PROVIDER).alias("provider"), "text")


_PASSAGES = SQL["t9_split_passages"].rsplit("SELECT doc_id, pos", 1)[0]
_TITLE = "substr(string_split(string_split(trim(text, chr(10) || ' '), chr(10))[1], '  ')[1], 1, 96)"
_PHRASES = f"list_concat({_GRAMS.format(k=3, stop=listed(T.RANK_STOPWORDS))}, {_GRAMS.format(k=2, stop=listed(T.RANK_STOPWORDS))})"
_SATURATE = "{idf} * {tf} * 2.35::DOUBLE / ({tf} + 1.35::DOUBLE * (0.28::DOUBLE + 0.72::DOUBLE * {l} / greatest(al, 1)))"


@query(
    _PASSAGES.rstrip()
    + rf""",
d AS (SELECT doc_id, {_TITLE} AS title, {_URL} AS url, {_PROVIDER} AS provider FROM documents),
d2 AS (SELECT *, {_WEIGHT_SQL} AS quality FROM (SELECT *, {_TIER_SQL} AS tier FROM (SELECT *, {sql_domain('url')} AS d FROM d))),
p AS (SELECT * FROM (SELECT doc_id, pos, passage, title, url, provider, quality, {sql_tokens("'Source title: ' || title || '. Source domain: ' || d || '. ' || passage")} AS t FROM each JOIN d2 USING (doc_id)) WHERE len(t) > 0),
st AS (SELECT count(*) AS n, avg(len(t)) AS al FROM p),
tf AS (SELECT doc_id, pos, token, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, pos, len(t) AS l, unnest(t) AS token FROM p) GROUP BY ALL),
idf AS (SELECT token, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, st GROUP BY token, n),
w AS (SELECT item_id AS qid, lower(trim(text)) AS ql, {sql_tokens('text')} AS qt, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_\-]{{1,}}') AS w FROM benchmark),
q AS (SELECT qid, ql, list_distinct(qt) AS qt, {_PHRASES} AS phrases FROM w),
terms AS (SELECT qid, unnest(qt) AS token FROM q),
lex AS (SELECT qid, doc_id, pos, sum({_SATURATE.format(idf='idf', tf='tf', l='l')}) AS s, count(*) AS shared FROM terms JOIN tf USING (token) JOIN idf USING (token), st GROUP BY ALL),
tt AS (SELECT doc_id, token, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(k) AS l, unnest(k) AS token FROM (SELECT doc_id, {sql_tokens('title')} AS k FROM d)) GROUP BY ALL),
th AS (SELECT qid, doc_id, sum({_SATURATE.format(idf='idf', tf='tf', l='l')}) AS s FROM terms JOIN tt USING (token) JOIN idf USING (token), st GROUP BY ALL),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(url || ':' || substr(passage, 1, 220)) ORDER BY doc_id, pos) AS copy FROM p) WHERE copy = 1),
sc AS (SELECT q.qid, u.doc_id, u.pos, url, (coalesce(lex.s, 0) + 0.16::DOUBLE * coalesce(th.s, 0) + (ql <> '' AND contains(lower(passage), ql))::INT + 0.75::DOUBLE * len(list_filter(phrases, lambda f: contains(lower(passage), f))) + 0.08::DOUBLE * len(list_filter(phrases, lambda f: contains(lower(title), f))))
  * quality * CASE WHEN provider = 'official' THEN 1.28::DOUBLE ELSE 1 END * CASE WHEN list_contains(qt, 'search') AND NOT list_contains(t, 'search') THEN 0.42::DOUBLE ELSE 1 END * CASE WHEN coalesce(shared, 0) < least(2, len(qt)) THEN 0.55::DOUBLE ELSE 1 END AS score
  FROM q CROSS JOIN u LEFT JOIN lex ON lex.qid = q.qid AND lex.doc_id = u.doc_id AND lex.pos = u.pos LEFT JOIN th ON th.qid = q.qid AND th.doc_id = u.doc_id),
a AS (SELECT *, {sql_domain('url')} AS domain, row_number() OVER (PARTITION BY qid, url ORDER BY round(score, 8) DESC, doc_id, pos) AS nu FROM sc WHERE score > 0),
b AS (SELECT *, (nu > 1 OR row_number() OVER (PARTITION BY qid, domain ORDER BY (nu > 1)::INT, round(score, 8) DESC, doc_id, pos) > 3)::INT AS later FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY later, round(score, 8) DESC, doc_id, pos) AS rank FROM b)
SELECT qid, doc_id AS did, pos, round(score, 6) AS score, rank FROM c WHERE rank <= 8"""
)
def a2_w1_rank_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return E.rank_evidence(q, _documents(spark, sf_dir)).select("qid", "did", F.col("pos").cast("long").alias("pos"), F.round("score", 6).alias("score"), "rank")


# Conversations as questions (the first user turn) with evidence (all user turns).
_TURN_URL = "CASE turn % 5 WHEN 0 THEN 'https://www.nih.gov/' WHEN 1 THEN 'https://x.reddit.com/' WHEN 2 THEN 'https://a.example.org/' ELSE 'https://docs.python.org/' END || turn // 2"
_TURN_URL_SPARK = _TURN_URL.replace("turn // 2", "cast(turn div 2 as string)")
_TURN_PROVIDER = "CASE turn % 4 WHEN 0 THEN 'official' WHEN 2 THEN 'seed' ELSE 'web' END"
_EV = f"""
WITH ev AS (SELECT conv_id AS qid, turn AS id, 'About ' || substr(text, 1, 40) AS title, {_TURN_URL} AS url, text AS passage, {_TURN_PROVIDER} AS provider, length(text) / 100::DOUBLE AS score FROM conversations WHERE role = 'user'),
q AS (SELECT qid, arg_min(passage, id) AS text FROM ev GROUP BY qid)"""


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    ev = c.select(F.col("conv_id").alias("qid"), F.col("turn").alias("id"), F.concat(F.lit("About "), F.substring("text", 1, 40)).alias("title"), F.expr(_TURN_URL_SPARK).alias("url"), F.col("text").alias("passage"), F.expr(_TURN_PROVIDER).alias("provider"), (F.length("text") / 100).alias("score"))
    return ev.groupBy("qid").agg(F.min_by("passage", "id").alias("text")), ev


_EV_TIER = f", t AS (SELECT *, {_TIER_SQL} AS tier FROM (SELECT *, {sql_domain('url')} AS d FROM ev))"


@query(
    _EV
    + _EV_TIER
    + f""", terms AS (SELECT qid, unnest(list_distinct({sql_tokens('text')})) AS token FROM q), words AS (SELECT DISTINCT qid, unnest({sql_tokens('passage')}) AS token FROM ev),
o AS (SELECT t.qid, count(w.token) / count(*)::DOUBLE AS overlap FROM terms t LEFT JOIN words w ON w.qid = t.qid AND w.token = t.token GROUP BY t.qid),
s AS (SELECT qid, count(*) AS evidence, count(DISTINCT nullif(d, '')) AS domains, count(*) FILTER (provider = 'official') AS official, count(*) FILTER (tier NOT IN ('general', 'low_signal')) AS trusted, count(*) FILTER (tier = 'low_signal') AS low_signal, max(score) AS top FROM t GROUP BY qid),
c AS (SELECT qid, coalesce(overlap, 0) AS overlap, s.* EXCLUDE (qid), least(1, least(coalesce(overlap, 0), 0.55) * 0.8::DOUBLE + least(top / 8, 0.25) + least(evidence / 8, 0.12) + least(domains / 4, 0.08) + CASE WHEN official > 0 THEN 0.08 ELSE 0 END + CASE WHEN trusted > 0 THEN least(trusted / 6, 0.08) ELSE 0 END - CASE WHEN low_signal > 0 AND trusted = 0 THEN 0.08 ELSE 0 END)::DOUBLE AS confidence FROM q JOIN s USING (qid) LEFT JOIN o USING (qid)),
r AS (SELECT *, list_filter([CASE WHEN evidence < 3 THEN 'too_few_evidence_passages' END, CASE WHEN overlap < 0.24 THEN 'low_query_coverage' END, CASE WHEN domains < 2 THEN 'low_source_diversity' END, CASE WHEN official = 0 AND trusted = 0 THEN 'no_curated_trusted_source' END], lambda x: x IS NOT NULL) AS reasons FROM c),
z AS (SELECT *, CASE WHEN round(confidence, 9) >= 0.58 AND len(reasons) = 0 THEN 'sufficient' WHEN round(confidence, 9) >= 0.38 THEN 'ambiguous' ELSE 'insufficient' END AS status FROM r)
SELECT qid, evidence, domains, official, trusted, low_signal, round(confidence, 6) AS confidence, array_to_string(reasons, ',') AS reasons, status, len(reasons) > 0 AND (status IN ('insufficient', 'ambiguous') OR confidence < 0.5) AS correct FROM z"""
)
def a5_f14_assess_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.assess(*_evidence(spark, sf_dir))
    return out.select("qid", "evidence", "domains", "official", "trusted", "low_signal", F.round("confidence", 6).alias("confidence"), F.array_join("reasons", ",").alias("reasons"), "status", "correct")


_PRIORITY = "CASE tier " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in U.TIER_PRIORITY.items()) + " END::DOUBLE"


@query(
    _EV
    + _EV_TIER
    + f""", u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, regexp_replace(url, '/+$', '') ORDER BY id) AS r FROM t) WHERE r = 1),
k AS (SELECT u.*, list_distinct({sql_tokens('text')}) AS qt, {sql_tokens('title')} AS tt, {sql_tokens('passage')} AS pt FROM u JOIN q USING (qid)),
s AS (SELECT qid, id, len(list_intersect(qt, list_concat(tt, pt))) / greatest(len(qt), 1)::DOUBLE * 3 + len(list_intersect(qt, tt)) / greatest(len(qt), 1)::DOUBLE * 2.2::DOUBLE + {_PRIORITY} + CASE provider WHEN 'official' THEN 0.7 WHEN 'seed' THEN 0.45 ELSE 0 END::DOUBLE + least(score, 10) * 0.04::DOUBLE - CASE WHEN tier = 'low_signal' THEN 1.2 ELSE 0 END::DOUBLE AS priority FROM k)
SELECT qid, id, round(priority, 6) AS priority, row_number() OVER (PARTITION BY qid ORDER BY round(priority, 8) DESC, id) AS new_id FROM s"""
)
def w2_w3_answer_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.answer_priority(*_evidence(spark, sf_dir)).select("qid", "id", F.round("priority", 6).alias("priority"), "new_id")


@query(_EV + ", a AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) - 1 AS at0, count(*) OVER (PARTITION BY qid) AS n FROM ev) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN n <= 2 THEN at0 WHEN at0 % 2 = 0 THEN at0 ELSE 1073741824 - at0 END) AS place FROM a")
def w14_sandwich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sandwich(_evidence(spark, sf_dir)[1]).select("qid", "id", "place")


# Pages as search results of the benchmark's items.
_RES = """
WITH res AS (SELECT page_id % 40 AS qid, page_id // 40 + 1 AS rank, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS snippet, CASE page_id % 9 WHEN 0 THEN 'seed' WHEN 1 THEN 'official' ELSE 'web' END AS provider FROM pages)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select((F.col("page_id") % 40).alias("qid"), F.expr("page_id div 40 + 1").alias("rank"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "url", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("snippet"), F.expr("CASE page_id % 9 WHEN 0 THEN 'seed' WHEN 1 THEN 'official' ELSE 'web' END").alias("provider"))


_NETLOC = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)"


@query(
    _RES
    + f""", k AS (SELECT r.*, lower(b.text) AS ql, list_distinct({sql_keywords('b.text')}) AS qk, list_distinct({sql_keywords('title')}) AS tk, list_distinct(list_concat({sql_keywords('title')}, {sql_keywords('snippet')}, {sql_keywords(f"replace({_NETLOC}, '.', ' ')")})) AS bk, {_TIER_SQL.replace("matches(d,", f"matches({sql_domain('url')},")} AS tier FROM res r JOIN benchmark b ON b.item_id = qid),
s AS (SELECT *, len(list_intersect(qk, bk)) / greatest(len(qk), 1)::DOUBLE * 2.2::DOUBLE + len(list_intersect(qk, tk)) / greatest(len(qk), 1)::DOUBLE * 1.6::DOUBLE + {_WEIGHT_SQL} + CASE WHEN {_WEIGHT_SQL} >= 1.18 THEN 1.6 ELSE 0 END::DOUBLE + CASE WHEN contains(lower(title || ' ' || snippet), ql) THEN 0.45 ELSE 0 END::DOUBLE + 0.35::DOUBLE / rank + CASE provider WHEN 'seed' THEN 1.6 WHEN 'official' THEN 0.55 ELSE 0 END::DOUBLE AS score FROM k)
SELECT qid, rank::BIGINT AS rank, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, rank) AS new_rank FROM s"""
)
def w4_rank_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return E.rank_results(q, _results(spark, sf_dir)).select("qid", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "new_rank")


@query(
    """
WITH b AS (SELECT page_id % 5 AS qid, (page_id // 5) % 4 AS batch, page_id // 20 + 1 AS rank, 'http://h.example.com/' || (page_id * 7) % 31 || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '#x' END AS url FROM pages),
s AS (SELECT qid, regexp_replace(split_part(url, '#', 1), '/+$', '') AS url, sum(CASE WHEN batch = 0 THEN 4 ELSE 1 END / (60 + rank)::DOUBLE) AS score, min((batch, rank)) AS first FROM b GROUP BY ALL)
SELECT qid, url, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first) AS rank FROM s"""
)
def w5_fuse_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused URLs and ranks; the choice of representatives is tested apart, as SQL has no fold for it."""
    url = "'http://h.example.com/' || cast((page_id * 7) % 31 as string) || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '#x' END"
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("qid"), F.expr("(page_id div 5) % 4").alias("batch"), F.expr("page_id div 20 + 1").alias("rank"), F.lit("t").alias("title"), F.expr(url).alias("url"), F.lit("").alias("snippet"), F.lit("web").alias("provider"))
    return E.fuse_results(rows).select("qid", "url", F.round("score", 9).alias("score"), "rank")


_COPIES = "'http://h.example.com/' || {n} || CASE page_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '#x' ELSE '' END || CASE WHEN page_id % 50 = 0 THEN '?ad_domain=1' ELSE '' END"


@query(f"SELECT page_id FROM (SELECT page_id, c, row_number() OVER (PARTITION BY c ORDER BY page_id) AS r FROM (SELECT page_id, regexp_replace(split_part(u, '#', 1), '/+$', '') AS c FROM (SELECT page_id, {_COPIES.format(n='page_id % 60')} AS u FROM pages)) WHERE NOT contains(c, 'ad_domain')) WHERE r = 1")
def d1_dedupe_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("pos"), F.expr(_COPIES.format(n="cast(page_id % 60 as string)")).alias("url"))
    return E.dedupe_results(rows).select("page_id")


@query(
    f"""
WITH d AS (SELECT doc_id AS pos, CASE WHEN doc_id % 13 = 0 THEN 'official' ELSE 'web' END AS provider, length(text) AS n, 'http://h.example.com/' || doc_id % 200 AS url FROM documents)
SELECT url, pos, first FROM (SELECT *, min(pos) OVER (PARTITION BY url) AS first, row_number() OVER (PARTITION BY url ORDER BY (provider = 'official') DESC, CASE WHEN provider = 'official' THEN pos ELSE -n END, pos) AS r FROM d) WHERE r = 1"""
)
def d2_dedupe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.expr("CASE WHEN doc_id % 13 = 0 THEN 'official' ELSE 'web' END").alias("provider"), "text", F.expr("'http://h.example.com/' || cast(doc_id % 200 as string)").alias("url"))
    return E.dedupe_documents(rows).select("url", "pos", "first")


# Assistant turns as answers, with citations put in; the conversation's user turns are the evidence.
_ANSWER = "CASE turn % 4 WHEN 1 THEN replace(text, '. ', ' [1]. ') || ' [2, 3]' ELSE '- ' || text || ' [1]' END"
_CL = rf"""
WITH ans AS (SELECT conv_id * 100 + turn AS qid, conv_id, {_ANSWER} AS answer FROM conversations WHERE role = 'assistant'),
evi AS (SELECT qid, e.id, e.title, e.passage FROM ans JOIN (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id, 'About ' || substr(text, 1, 40) AS title, text AS passage FROM conversations WHERE role = 'user') e USING (conv_id)),
lines AS (SELECT qid, unnest(string_split(answer, chr(10))) AS line, unnest(range(len(string_split(answer, chr(10))))) AS line_no FROM ans),
bare AS (SELECT qid, line_no, regexp_replace(trim(line), '^\s*(?:[-*]\s+|\d+[.)]\s*)', '') AS line FROM lines),
parts AS (SELECT qid, line_no, line, list_filter(list_transform(string_split(regexp_replace(regexp_replace(line, '([.!?])\s+(\[\d)', '\1' || chr(2) || '\2', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(replace(x, chr(2), ' '))), lambda x: x <> '') AS p FROM bare WHERE line <> ''),
each AS (SELECT qid, line_no, line, unnest(p) AS part, unnest(range(len(p))) AS part_no FROM parts),
ids AS (SELECT *, list_transform(regexp_extract_all(array_to_string(regexp_extract_all(part, '\[\d+(?:\s*,\s*\d+)*\]'), ' '), '\d+'), lambda x: x::INT) AS own, list_transform(regexp_extract_all(array_to_string(regexp_extract_all(line, '\[\d+(?:\s*,\s*\d+)*\]'), ' '), '\d+'), lambda x: x::INT) AS whole FROM each),
claims AS (SELECT qid, line_no * 10000 + part_no AS pos, trim(trim(regexp_replace(regexp_replace(part, '\[\d+(?:\s*,\s*\d+)*\]', '', 'g'), '\s+', ' ', 'g')), ' :-') AS claim, list_sort(list_distinct(CASE WHEN len(own) > 0 THEN own ELSE whole END)) AS ids FROM ids),
kept AS (SELECT * FROM claims WHERE claim <> '' AND NOT (len(ids) = 0 AND (lower(claim) LIKE 'based on%' OR length(claim) < 42 OR claim LIKE '%:')))"""


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations")
    answers = c.where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("qid"), "conv_id", F.expr(_ANSWER).alias("answer"))
    users = c.where("role = 'user'").selectExpr("conv_id", "row_number() over (partition by conv_id order by turn) as id", "'About ' || substr(text, 1, 40) as title", "text as passage")
    return C.split_answers(answers), answers.select("qid", "conv_id").join(users, "conv_id").drop("conv_id")


@query(_CL + " SELECT qid, pos::BIGINT AS pos, md5(claim) AS claim, array_to_string(ids, ',') AS ids FROM kept")
def t24_t26_split_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir)[0].select("qid", "pos", F.md5("claim").alias("claim"), F.array_join(F.array_sort("citation_ids").cast("array<string>"), ",").alias("ids"))


@query(
    _CL
    + f""", ct AS (SELECT qid, pos, ids, list_distinct({sql_support_tokens('claim')}) AS ct FROM kept), x AS (SELECT qid, pos, ct, unnest(ids) AS id FROM ct),
s AS (SELECT x.qid, x.pos, CASE WHEN len(ct) = 0 OR len({sql_support_tokens("title || ' ' || passage")}) = 0 THEN 0 ELSE least(1, len(list_intersect(ct, {sql_support_tokens("title || ' ' || passage")})) / len(ct)::DOUBLE + CASE WHEN len(list_intersect(ct, {sql_support_tokens('title')})) > 0 THEN 0.04::DOUBLE ELSE 0 END) END AS s FROM x JOIN evi ON evi.qid = x.qid AND evi.id = x.id),
m AS (SELECT qid, pos, max(s) AS s FROM s GROUP BY ALL)
SELECT qid, pos::BIGINT AS pos, round(coalesce(s, 0), 6)::DOUBLE AS support, CASE WHEN len(ids) = 0 THEN 'missing_citation' WHEN s IS NULL THEN 'unsupported' WHEN s >= 0.22 THEN 'supported' WHEN s >= 0.08 THEN 'weak' ELSE 'needs_review' END AS status FROM ct LEFT JOIN m USING (qid, pos)"""
)
def a6_a7_verify_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.verify(*_claims(spark, sf_dir)).select("qid", "pos", F.round("support", 6).alias("support"), "status")


# Judgements of two claims in three, with verdicts in several spellings and confidences beyond both ends.
_VERDICTS = ["Contradicted", "unsure", "SUPPORTED", "insufficient", "weak", "weak "]
_GIVEN_VERDICT = "CASE WHEN pos % 7 < 6 THEN [" + ", ".join(f"'{v}'" for v in _VERDICTS) + "][(pos % 7 + 1)::INT] END"


@query(
    _CL
    + f""", g AS (SELECT qid, pos, {_GIVEN_VERDICT} AS verdict, (length(claim) % 13 - 3) / 5.0::DOUBLE AS confidence, pos % 3 < 2 AS judged FROM kept)
SELECT qid, pos::BIGINT AS pos, CASE WHEN judged AND lower(verdict) IN ('supported', 'weak', 'contradicted', 'insufficient') THEN lower(verdict) ELSE 'needs_review' END AS status, CASE WHEN judged THEN greatest(0, least(1, confidence)) ELSE 0.1 END::DOUBLE AS support, CASE WHEN judged THEN 'judge' ELSE 'lexical' END AS verifier FROM g"""
)
def j13_merge_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)[0].select("qid", "pos", "claim", F.lit("needs_review").alias("status"), F.lit(0.1).alias("support"))
    verdict = F.get(F.array(*map(F.lit, _VERDICTS)), (F.col("pos") % 7).cast("int"))
    judged = claims.where("pos % 3 < 2").select("qid", "pos", verdict.alias("verdict"), ((F.length("claim") % 13 - 3) / 5.0).alias("confidence"))
    return C.merge_judgements(claims.drop("claim"), judged)


# Planning, on the benchmark's texts behind a few leading words.
_Q = "CASE item_id % 8 WHEN 0 THEN 'compare ' WHEN 1 THEN 'how to use ' WHEN 2 THEN 'why ' WHEN 3 THEN 'best API for ' WHEN 4 THEN 'latest news: ' WHEN 5 THEN 'comprehensive legal ' WHEN 6 THEN 'python json ' ELSE '' END || text"
_MODE = "CASE item_id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'pro' ELSE 'deep' END"


def _ascii(pattern: str) -> str:
    return pattern[: next((i for i, c in enumerate(pattern) if ord(c) > 127), len(pattern) + 1) - 1] if any(ord(c) > 127 for c in pattern) else pattern


def _m(pattern: str) -> str:
    return f"regexp_matches(q, '(?i){_ascii(pattern)}')"


_PLAN = f"""
WITH p AS (SELECT item_id, {_Q} AS q, {_MODE} AS mode FROM benchmark), f AS (SELECT *, {_m(P.COMPLEX)} AS hard, {_m(P.MAX)} AS most, {_m(T.FRESHNESS)} AS fresh, CASE WHEN {_m(P.COMPARE)} THEN 'comparison' WHEN {_m(P.RECOMMEND)} THEN 'recommendation' WHEN {_m(P.API)} THEN 'api_or_code' WHEN {_m(P.COMPLEX)} THEN 'analysis' ELSE 'lookup' END AS intent FROM p),
plan AS (SELECT *, CASE WHEN most THEN 'max' WHEN mode = 'deep' OR hard OR intent IN ('comparison', 'recommendation', 'api_or_code') THEN 'high' ELSE 'none' END AS effort, CASE WHEN mode = 'deep' OR most THEN 'deep' WHEN mode = 'pro' OR hard OR fresh THEN 'pro' ELSE 'fast' END AS depth FROM f)"""


@query(_PLAN + " SELECT item_id, intent, fresh AS needs_freshness, depth AS search_depth, effort AS reasoning_effort, CASE greatest(list_position(['fast', 'pro', 'deep'], mode), list_position(['fast', 'pro', 'deep'], depth)) WHEN 1 THEN 'fast' WHEN 2 THEN 'pro' ELSE 'deep' END AS mode FROM plan")
def f6_f9_query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.expr(_MODE).alias("m"), P.plan(F.expr(_Q), F.expr(_MODE)).alias("p"))
    return rows.select("item_id", "p.intent", "p.needs_freshness", "p.search_depth", "p.reasoning_effort", P.deeper(F.col("m"), F.col("p.search_depth")).alias("mode"))


@query("SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'high' WHEN 2 THEN 'max' WHEN 3 THEN 'high' WHEN 4 THEN 'max' ELSE 'none' END AS effort, CASE item_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.62 ELSE 0.0 END::DOUBLE AS confidence FROM benchmark")
def f7_coerce_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    effort = F.expr("CASE item_id % 6 WHEN 0 THEN 'Off' WHEN 1 THEN 'medium' WHEN 2 THEN 'XHIGH' WHEN 3 THEN 'high' WHEN 4 THEN 'maximum' ELSE '?' END")
    confidence = F.expr("CASE item_id % 3 WHEN 0 THEN '1.7' WHEN 1 THEN 'abc' ELSE '-2' END")
    return table(spark, sf_dir, "benchmark").select("item_id", P.coerce_effort(effort, F.lit("none")).alias("effort"), P.coerce_confidence(confidence, F.lit(0.62)).alias("confidence"))


@query(
    _PLAN
    + """ SELECT item_id, array_to_string(list_filter(['official', 'evidence', CASE WHEN fresh THEN 'freshness' END, CASE WHEN check_it THEN 'countercheck' END, CASE WHEN NOT fresh AND NOT check_it THEN 'context' END, CASE WHEN deep THEN 'synthesis' END], lambda x: x IS NOT NULL)[1:5], ',') AS steps
FROM (SELECT *, effort = 'max' OR depth = 'deep' AS deep, effort = 'max' OR depth = 'deep' OR intent IN ('comparison', 'recommendation', 'analysis', 'api_or_code') AS check_it FROM plan)"""
)
def f13_research_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.expr(_Q).alias("q"), P.plan(F.expr(_Q), F.expr(_MODE)).alias("p"))
    return rows.select("item_id", F.array_join(F.transform(P.research_steps(F.col("q"), F.col("p")), lambda s: s["label"]), ",").alias("steps"))


_KINDS = " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(words)}') THEN '{kind}'" for kind, words in P.QUESTION_WORDS.items())


@query(f"SELECT item_id, CASE {_KINDS} ELSE 'local' END AS kind FROM (SELECT item_id, ['impact of ', 'how does it ', 'is it between ', 'overview: ', '影响 ', 'x '][(item_id % 6 + 1)::INT] || substr(md5(text), 1, 6) AS text FROM benchmark)")
def f20_question_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.element_at(F.array(*map(F.lit, ("impact of ", "how does it ", "is it between ", "overview: ", "影响 ", "x "))), (F.col("item_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select("item_id", P.question_type(F.concat(lead, F.substring(F.md5("text"), 1, 6))).alias("kind"))


@query(f"SELECT doc_id, CASE {_KINDS} ELSE 'local' END AS kind FROM documents")
def f20_question_type_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.question_type(F.col("text")).alias("kind"))
