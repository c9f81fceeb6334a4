"""Queries of HTML, files, lexical features, digests, answers and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import html_text as H
from tessera.functions import text as T
from tessera.operators import code_graph as CG
from tessera.operators import lexical as L
from tessera.plans.graph_queries import _graph
from tessera.plans.registry import query, table
from tessera.plans.retrieval_queries import _PAIRS, _dense
from tessera.sources import files


@query()
def t8_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.extract_html(F.col("html"), F.col("url")).alias("x")).select("page_id", "x.title", "x.text")


_LEX = r"""
WITH q AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_.%+-]+') AS t FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_.%+-]+') AS t FROM documents),
p AS (SELECT item_id, doc_id FROM benchmark JOIN documents ON true),
qc AS (SELECT item_id, token, count(*) AS qc, any_value(n) AS qn FROM (SELECT item_id, len(t) AS n, unnest(t) AS token FROM q) GROUP BY ALL), dc AS (SELECT doc_id, token, count(*) AS dc, any_value(n) AS dn FROM (SELECT doc_id, len(t) AS n, unnest(t) AS token FROM d) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(least(qc, dc)) AS o, any_value(qn) AS qn, any_value(dn) AS dn, sum(CASE WHEN length(token) >= 2 THEN ln(1 + qc + dc) ELSE 0 END) AS b FROM p JOIN qc USING (item_id) JOIN dc USING (doc_id, token) GROUP BY ALL)
SELECT item_id AS qid, doc_id AS did, round(coalesce(2 * (o / dn::DOUBLE) * (o / qn::DOUBLE) / greatest(o / dn::DOUBLE + o / qn::DOUBLE, 1e-12) + 0.02::DOUBLE * b, 0), 6) AS score FROM p LEFT JOIN s USING (item_id, doc_id)"""


@query(_LEX)
def a4_lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), T.rerank_tokens(F.col("text")).alias("tokens"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("did"), T.rerank_tokens(F.col("text")).alias("tokens"))
    return L.every_lexical_score(q, d).select("qid", "did", F.round("score", 6).alias("score"))


@query()
def h2_feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("did"), "text")
    return L.feature_columns(q, d)


@query("SELECT 'benchmark' AS task, item_id, sha1(text) AS digest, CASE WHEN item_id % 2 = 0 THEN 'title ' || item_id || chr(10) || text ELSE text END AS body, regexp_replace(lower(substr(text, 1, 30)), '[^a-z0-9]+', '-', 'g') AS slug, sha256('q' || item_id || chr(0) || 'x' || chr(0) || text) || ':0' AS cid FROM benchmark")
def m14_t31_w13_digests_and_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").alias("pos"), F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("qid"), F.lit("x").alias("query"), F.col("text").alias("doc"))
    title = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("title "), F.col("item_id").cast("string"))).otherwise("")
    body = F.when((title != "") & (F.col("doc") != ""), F.concat_ws("\n", title, "doc")).otherwise(F.concat(title, "doc"))
    return files.candidate_ids(rows).select(F.lit("benchmark").alias("task"), "item_id", F.sha1("doc").alias("digest"), body.alias("body"), F.regexp_replace(F.lower(F.substring("doc", 1, 30)), "[^a-z0-9]+", "-").alias("slug"), "cid")


@query(_PAIRS + "SELECT qid || ' Q0 ' || did || ' ' || r1 || ' ' || printf('%.10f', round(s1, 6)) || ' run' AS value FROM ranked WHERE r1 <= 10")
def s6_trec_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _dense(spark, sf_dir, 10).withColumn("score", F.round("score", 6))
    return files.trec_lines(run, "run")


@query(_PAIRS + ", v AS (SELECT qid, did, r1 FROM ranked WHERE r1 <= 10 AND NOT (qid % 60 = 0 AND r1 = 10)) SELECT vec_id AS qid, 'missing' AS problem FROM embeddings WHERE vec_id = 1 UNION ALL SELECT qid, 'depth' FROM v GROUP BY qid HAVING count(*) <> 10")
def s7_validate_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _dense(spark, sf_dir, 10).where("not (qid % 60 = 0 and rank = 10)")
    queries = run.select("qid").distinct().unionByName(spark.range(1, 2).select(F.col("id").alias("qid")))
    return files.validate_run(run, queries, 10)


@query("SELECT page_id, list_contains(['http://', 'https://'], regexp_extract(url, '^https?://')) AND (contains(rtrim(url, '/'), 'blog.') OR contains(rtrim(url, '/'), '/en')) AS found FROM pages")
def j12_expected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any expected part is in a page's URL."""
    expected = F.array(F.lit("blog."), F.lit("/en/"))
    url = F.regexp_replace("url", "/+$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.exists(expected, lambda e: F.contains(url, F.regexp_replace(e, "/+$", ""))).alias("found"))


@query()
def g7_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CG.communities(_graph(spark, sf_dir)[1].where("kind = 'contains'").select("src", "dst"), 6)
