"""Queries of further filters, counters, digests and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import planning as P
from tessera.functions import text as T
from tessera.operators import metrics as M
from tessera.operators import sampling as S
from tessera.plans.lab_queries import _fraction
from tessera.plans.registry import query, table
from tessera.plans.retrieval_queries import _PAIRS, _RUN, _SCORED, _SIZES, _dense, _metric_sql, _run_metrics, _scored


@query(
    """
WITH i AS (SELECT source AS key, doc_id AS idx, ((n_chars * 7 + doc_id) % 701)::DOUBLE AS a, ((n_chars * 11 + doc_id) % 503)::DOUBLE AS b FROM documents),
x AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY key ORDER BY a, idx) <= 3 THEN 'a' END AS taken FROM i),
y AS (SELECT key, idx, a, b, CASE WHEN taken IS NULL AND row_number() OVER (PARTITION BY key, taken IS NULL ORDER BY b, idx) <= 2 THEN 'b' ELSE taken END AS taken FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY (taken IS NULL)::INT, a + b, idx) AS place FROM y) SELECT key, idx, coalesce(taken, 'filler') AS surface FROM z WHERE place <= 8"""
)
def l7_surface_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (((F.col("n_chars") * k + F.col("doc_id")) % m).cast("double") for k, m in ((7, 701), (11, 503)))
    items = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("idx"), a.alias("a"), b.alias("b"))
    return S.surface_quotas(items, {"a": 3, "b": 2}, 8)


@query(
    f"""
WITH r AS (SELECT conv_id AS qid, text AS doc, (role = 'user')::INT AS label FROM conversations), c AS (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY label DESC) AS copy FROM r)
SELECT qid, md5(doc) AS doc, label, row_number() OVER (PARTITION BY qid ORDER BY {_fraction('flat', "qid || ':' || doc || ':' || copy")}, doc, copy) - 1 AS pos FROM c"""
)
def l11_flatten_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    side = lambda user: F.collect_list(F.when((F.col("role") == "user") == user, F.col("text")))
    records = c.groupBy(F.col("conv_id").alias("qid")).agg(side(True).alias("positives"), side(False).alias("negatives"))
    return S.flatten_records(records, "flat").select("qid", F.md5("doc").alias("doc"), "label", "pos")


@query(_PAIRS + _SIZES + _RUN + _metric_sql("run") + ", t AS (SELECT label, count(*) AS queries, avg(ndcg) AS ndcg FROM m JOIN embeddings ON vec_id = qid GROUP BY label) SELECT round(sum(ndcg * queries) / sum(queries), 6) AS ndcg FROM t")
def a11_weighted_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks are labels."""
    by_query = _run_metrics(spark, sf_dir, _dense(spark, sf_dir, 50)).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), "label"), "qid")
    return M.weighted_average(M.mean_metrics(by_query, "label"), "ndcg").select(F.round("ndcg", 6).alias("ndcg"))


@query(_SCORED + ", c AS (SELECT qid, coalesce(min(CASE WHEN label > 0 THEN s1 END) - max(CASE WHEN label <= 0 THEN s1 END), 0) AS margin, max(CASE WHEN r = 1 THEN label END) AS first FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s1 DESC, did) AS r FROM scored) GROUP BY qid) SELECT qid, round(margin, 6) AS margin FROM c WHERE margin < 0.01 OR first = 0 ORDER BY round(margin, 8), qid LIMIT 10")
def w21_hard_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).withColumnRenamed("s1", "score")
    first = scored.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "did"))).where("r = 1").select("qid", F.col("label").alias("first"))
    hard = M.least_positive_margin(scored).join(first, "qid").where((F.col("margin") < 0.01) | (F.col("first") == 0))
    return hard.orderBy(F.round("margin", 8), "qid").limit(10).select("qid", F.round("margin", 6).alias("margin"))


@query("SELECT item_id, array_to_string(list_filter(w, lambda x, i: x <> '' AND list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i), ' ') AS kept, round(len(list_intersect(list_distinct(w), list_distinct(v))) / len(list_distinct(list_concat(w, v)))::DOUBLE, 6) AS jaccard FROM (SELECT item_id, string_split(text, ' ') AS w, string_split(lower(text), ' ') AS v FROM benchmark)")
def d3_d5_distinct_and_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, v = F.split("text", " "), F.split(F.lower("text"), " ")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(P.distinct_ignoring_case(w), " ").alias("kept"), F.round(T.jaccard(w, v), 6).alias("jaccard"))
