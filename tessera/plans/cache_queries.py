"""Queries of the response cache and of answer scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import answers as N
from tessera.functions import text as T
from tessera.operators import caching as K
from tessera.plans.registry import query, sql_fingerprint, table
from tessera.plans.text_queries import _NORMAL, _TAGS

NOW = 1706659200.0  # the end of the events' month, in seconds


@query("WITH e AS (SELECT event_id, user_id, epoch(ts)::DOUBLE AS at0 FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at0 DESC, event_id DESC) AS r FROM e) SELECT user_id, event_id FROM l WHERE r = 1 AND 1706659200 - at0 <= 86400")
def s14_cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry of each key, if it is younger than a day."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = e.withColumns({"created_at": F.col("us") / 1e6, "o": F.struct("us", "event_id")})
    rows = K.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "o")
    return K.alive(rows, NOW).select("user_id", "event_id")


@query("SELECT event_id AS cid FROM events ORDER BY user_id DESC, epoch(ts) DESC, event_id LIMIT 512")
def l15_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("cid"), F.col("user_id").alias("last_hit"), F.col("ts").alias("created_at"))
    return K.evict(e).select("cid")


_FRESH = r"regexp_matches(q, '(?i)\b(latest|today|current|now|recent|new|202[5-9])\b')"
_ASK = "CASE item_id % 5 WHEN 0 THEN 'latest ' WHEN 1 THEN 'in 2026 ' ELSE '' END || text"


@query(f"SELECT item_id, item_id % 7 < 2 OR {_FRESH} AS fresh, CASE WHEN item_id % 7 < 2 OR {_FRESH} THEN 300 ELSE 3600 END AS ttl, sha256('{{\"lens\":\"web\",\"mode\":\"fast\",\"query\":' || to_json(q)::VARCHAR || '}}') AS key FROM (SELECT item_id, {_ASK} AS q FROM benchmark)")
def f16_f17_request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.expr(_ASK).alias("q"), F.expr("CASE item_id % 7 WHEN 0 THEN 'day' WHEN 1 THEN 'week' ELSE 'any' END").alias("recency"))
    key = K.request_key({"query": F.col("q"), "mode": F.lit("fast"), "lens": F.lit("web")})
    return rows.select("item_id", K.fresh_only(F.col("q"), F.col("recency")).alias("fresh"), K.ttl(F.col("q"), F.col("recency")).alias("ttl"), key.alias("key"))


_NEAR_TEXT = "CASE WHEN item_id % 3 = 0 THEN 'extraword ' ELSE '' END || CASE WHEN item_id % 4 = 0 THEN replace(text, ' ', '  ') ELSE text END"
_N = r"list_sort(list_distinct(regexp_extract_all({x}, '\d+')))"
_CACHE = f"""
WITH b AS (SELECT item_id, text, {_NEAR_TEXT} AS asked FROM benchmark),
c AS (SELECT item_id AS cid, text AS q, {sql_fingerprint(_NORMAL)} AS tok, {_TAGS.replace('(q,', '(text,')} AS tags, {_N.format(x=_NORMAL)} AS nums, item_id % 2 AS scope, item_id * 60 AS age FROM b),
r AS (SELECT item_id AS rid, {sql_fingerprint(_NORMAL.replace('text', 'asked'))} AS tok, {_TAGS.replace('(q,', '(asked,')} AS tags, {_N.format(x=_NORMAL.replace('text', 'asked'))} AS nums, item_id % 2 AS scope FROM b)"""


@query(
    _CACHE
    + " , j AS (SELECT rid, cid, len(list_intersect(r.tok, c.tok)) / len(list_distinct(list_concat(r.tok, c.tok)))::DOUBLE AS score FROM r JOIN c ON r.scope = c.scope AND r.tags = c.tags AND r.nums = c.nums WHERE len(r.tok) >= 4 AND age <= 3600), k AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, cid) AS n FROM j WHERE score >= 0.86) SELECT rid, cid, round(score, 6) AS score FROM k WHERE n = 1"
)
def j10_near_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").withColumn("asked", F.expr(_NEAR_TEXT))

    def prepared(c: str) -> list:
        n = T.normalize_query(F.col(c))
        return [(F.col("item_id") % 2).alias("scope"), T.fingerprint_tokens(n).alias("tokens"), T.intent_tags(F.col(c)).alias("tags"), T.number_tokens(n).alias("numbers"), F.lit(5).alias("max_results")]

    cached = rows.select(F.col("item_id").alias("cid"), F.col("item_id").cast("string").alias("query"), F.lit("any").alias("recency"), (F.lit(NOW) - F.col("item_id") * 60).alias("created_at"), F.lit(0).alias("last_hit"), *prepared("text"))
    return K.near_matches(rows.select(F.col("item_id").alias("rid"), *prepared("asked")), cached, NOW).select("rid", F.col("query").cast("long").alias("cid"), F.round("score", 6).alias("score"))


# Entries have keys that up to three items share, and different ages; of equal requests each gets all live entries of its key.
_REQ = "CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN 'again' ELSE left(text, 1) END"


@query(f"WITH c AS (SELECT item_id, {_REQ} AS k, (item_id * 200)::BIGINT AS age FROM benchmark) SELECT r.item_id AS rid, e.item_id::VARCHAR AS query, e.age FROM c r JOIN c e USING (k) WHERE e.age <= 3600")
def j11_exact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").withColumn("cache_key", K.request_key({"q": F.expr(_REQ)}))
    cached = b.select("cache_key", F.col("item_id").cast("string").alias("query"), (F.lit(NOW) - F.col("item_id") * 200).alias("created_at"))
    return K.exact_matches(b.select(F.col("item_id").alias("rid"), "cache_key"), cached, NOW).select("rid", "query", "age")


# Worked answers: marks, phrases, plain endings and none, with numbers from the rows.
_WORKED = """CASE o_orderkey % 8 WHEN 0 THEN 'We get 3 then 4. #### ' || o_custkey || ' apples' WHEN 1 THEN 'First 12. The answer is ' || o_custkey || '.' WHEN 2 THEN 'So 7 and -' || o_custkey || ',000' WHEN 3 THEN 'none'
 WHEN 4 THEN '#### none 5' || o_custkey WHEN 5 THEN 'answer: 1/' || o_custkey || ' therefore +' || o_orderkey || '.50' WHEN 6 THEN 'Final answer 3, or ' || o_custkey || '/7 therefore nothing' ELSE '' || o_orderkey || ' #### 2 #### none' END"""
_NUMBER = r"'[-+]?\d[\d,]*(?:\.\d+)?(?:/\d[\d,]*)?'"
_LAST = f"regexp_extract_all({{x}}, {_NUMBER})[-1]"
_AFTER = "CASE WHEN contains(lower(t), '{m}') THEN " + _LAST.format(x="string_split(lower(t), '{m}')[-1]") + " END"


@query(f"SELECT o_orderkey, CASE WHEN contains(t, '####') THEN nullif(regexp_extract(string_split(t, '####')[-1], {_NUMBER}), '') ELSE coalesce({', '.join(_AFTER.replace('{m}', m) for m in N.MARKERS)}, {_LAST.format(x='t')}) END AS answer FROM (SELECT o_orderkey, {_WORKED} AS t FROM orders)")
def t34_extract_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", N.raw_answer(F.expr(_WORKED)).alias("answer"))


# Signs, separators, zeros, fractions, units and words, with numbers from the rows.
_WRITTEN = """CASE o_orderkey % 12 WHEN 0 THEN '$' || o_custkey || '.' WHEN 1 THEN '1/' || (o_custkey % 8) WHEN 2 THEN 'n/a' WHEN 3 THEN '1,' || lpad(cast(o_custkey % 1000 as string), 3, '0') || '.250%' WHEN 4 THEN '-' || o_custkey || '00' WHEN 5 THEN '+0' || o_custkey || '.0'
 WHEN 6 THEN '1/-' || o_custkey WHEN 7 THEN '-' || o_custkey || '/4' WHEN 8 THEN '0.00' || o_custkey WHEN 9 THEN '.' || o_custkey WHEN 10 THEN ' ' || o_custkey || ' km' ELSE '-0' || repeat('0', cast(o_custkey % 3 as int)) END"""
_PLAIN_NUMBER = r"regexp_matches(b, '^[-+]?\d*\.?\d+$')"
_BODY = "ltrim(regexp_replace(b, '^[-+]', ''), '0')"
_FRAC = "rtrim(CASE WHEN contains(b, '.') THEN string_split(b, '.')[2] ELSE '' END, '0')"
_INT = f"string_split({_BODY}, '.')[1]"
_SIGN = "CASE WHEN b LIKE '-%' THEN '-' ELSE '' END"
_EXP = f"CASE WHEN {_INT} = '' THEN '0' WHEN {_INT} NOT LIKE '%0' THEN {_INT} ELSE {_INT}[1] || CASE WHEN length(rtrim({_INT}, '0')) > 1 THEN '.' || rtrim({_INT}, '0')[2:] ELSE '' END || 'e' || (length({_INT}) - 1) END"
_DIVIDED = r"rtrim(rtrim((regexp_extract(b, '^([-+]?\d+)/', 1)::DECIMAL(30, 6) / regexp_extract(b, '/(\d+)$', 1)::INT)::DECIMAL(38, 9)::VARCHAR, '0'), '.')"


@query(
    rf"""WITH w AS (SELECT o_orderkey, o_custkey, trim(regexp_replace({_WRITTEN.replace('as string', 'as varchar')}, '[,$%]', '', 'g')) AS a FROM orders), x AS (SELECT o_orderkey, o_custkey, rtrim(a, '.') AS b FROM w)
SELECT o_orderkey, CASE WHEN regexp_matches(b, '^[-+]?\d+/[1-9]\d*$') AND o_orderkey % 12 = 7 THEN CASE WHEN o_custkey % 4 = 0 THEN rtrim((-(o_custkey // 4))::VARCHAR, '0') ELSE {_DIVIDED} END WHEN o_orderkey % 12 = 1 THEN ['1/0', '1', '0.5', '0.3333333333333333333333333333', '0.25', '0.2', '0.1666666666666666666666666667', '0.1428571428571428571428571429'][o_custkey % 8 + 1]
 WHEN {_PLAIN_NUMBER} THEN {_SIGN} || CASE WHEN {_FRAC} <> '' THEN CASE WHEN {_INT} = '' THEN '0' ELSE {_INT} END || '.' || {_FRAC} ELSE {_EXP} END ELSE b END AS number FROM x"""
)
def t35_normalize_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", N.normalize_number(F.expr(_WRITTEN)).alias("number"))


_GIVEN = "CASE o_orderkey % 6 WHEN 0 THEN o_custkey || '.' || lpad(cast(o_custkey % 1000 as string), 9, '0') WHEN 1 THEN ' x' || o_custkey % 3 || ' ' WHEN 2 THEN o_custkey || '.5' WHEN 3 THEN cast(o_totalprice as string) WHEN 4 THEN '-' || o_custkey END"
_GOLD = "CASE o_orderkey % 6 WHEN 1 THEN 'x' || o_custkey % 2 WHEN 2 THEN cast(o_custkey + (o_custkey % 2) as string) || '.5' WHEN 3 THEN cast(o_totalprice as string) || '1' WHEN 4 THEN cast(-o_custkey as string) || '.0' ELSE cast(o_custkey as string) END"
_NUM = "TRY_CAST({x} AS DECIMAL(38, 12))"


@query(
    f"""SELECT o_orderkey, coalesce(p = g OR CASE WHEN {_NUM.format(x='p')} IS NOT NULL AND {_NUM.format(x='g')} IS NOT NULL THEN abs({_NUM.format(x='p')} - {_NUM.format(x='g')}) <= greatest(0.000001, abs({_NUM.format(x='g')}::DOUBLE) * 0.000001) ELSE trim(p) = trim(g) END, false) AS same
FROM (SELECT o_orderkey, {_GIVEN.replace('as string', 'as varchar')} AS p, {_GOLD.replace('as string', 'as varchar')} AS g FROM orders)"""
)
def a30_answers_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", N.answers_match(F.expr(_GIVEN), F.expr(_GOLD)).alias("same"))


@query(
    "WITH u AS (SELECT l_orderkey AS k, l_linenumber AS i, nullif((l_partkey % 3)::VARCHAR, '2') AS p FROM lineitem), v AS (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY i, p) AS i FROM u), c AS (SELECT k, p, count(*) AS n, min(i) AS first FROM v WHERE p IS NOT NULL GROUP BY ALL), b AS (SELECT k, arg_max(p, (n, -first)) AS p FROM c GROUP BY k) SELECT DISTINCT v.k AS l_orderkey, b.p AS vote FROM v LEFT JOIN b USING (k)"
)
def a29_majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.nullif((F.col("l_partkey") % 3).cast("string"), F.lit("2")).alias("p")).alias("x"))
    votes = v.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return votes.select("l_orderkey", N.majority(F.transform("xs", lambda x: x["p"])).alias("vote"))


@query("SELECT round(avg((l_quantity > 25)::INT), 6) AS pass_at_1, count(*)::BIGINT AS n FROM lineitem")
def a31_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.round(F.avg((F.col("l_quantity") > 25).cast("int")), 6).alias("pass_at_1"), F.count("*").alias("n"))
