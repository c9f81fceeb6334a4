"""Queries of retrieval, fusion and metrics.

Queries are the benchmark items against all documents, and the vectors whose id is divisible
by 20 against all vectors; vectors of the same label are relevant.  A second surface
is made of the first 16 dimensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import arrays as A
from tessera.functions import text as T
from tessera.operators import fusion as fuse
from tessera.operators import metrics as M
from tessera.operators import retrieval as R
from tessera.operators import term_search as TS
from tessera.plans.registry import listed, query, sql_tokens, table

_CODE = r"regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|\d+|==|!=|<=|>=|[-+*/%]=?|[{}()\[\].,;:]')"
_CAMEL = r"list_filter(list_transform(string_split(replace(regexp_replace(t, '([a-z0-9])([A-Z])', '\1' || chr(1) || '\2', 'g'), '_', chr(1)), chr(1)), lambda p: lower(p)), lambda p: p <> '')"
_CODE_TOKENS = f"flatten(list_transform({_CODE}, lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z_]') THEN list_concat([lower(t)], {_CAMEL}) ELSE [lower(t)] END))"


def _bm25_sql(doc_tokens: str, query_tokens: str, k1: float, b: float, weight: str) -> str:
    return f"""
WITH d AS (SELECT doc_id, {doc_tokens} AS t FROM documents), q AS (SELECT item_id, {query_tokens} AS t FROM benchmark),
st AS (SELECT count(*) AS n, avg(len(t)) AS al FROM d),
qt AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest(t) AS token FROM q) GROUP BY ALL),
p AS (SELECT doc_id, l, token, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS token FROM d) GROUP BY ALL),
i AS (SELECT token, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM p, st GROUP BY token, n),
s AS (SELECT item_id, doc_id, sum(idf * (tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * l / al))) * {weight}) AS score
      FROM qt JOIN p USING (token) JOIN i USING (token), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM s)
SELECT item_id AS qid, doc_id AS did, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""


def _shown(run: DataFrame, digits: int = 6) -> DataFrame:
    return run.select("qid", "did", F.round("score", digits).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_bm25_sql(_CODE_TOKENS, _CODE_TOKENS, 0.9, 0.4, "(1 + ln(1 + qtf::DOUBLE))"))
def j1_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), T.code_tokens(F.col("text")).alias("tokens"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("did"), T.code_tokens(F.col("text")).alias("tokens"))
    return _shown(TS.bm25_top_k(q, d, 10, 0.9, 0.4, True))


@query(_bm25_sql(sql_tokens("text"), sql_tokens("text"), 1.35, 0.72, "1"))
def a1_bm25_plain_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), T.tokenize(F.col("text")).alias("tokens"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("did"), T.tokenize(F.col("text")).alias("tokens"))
    return _shown(TS.bm25_top_k(q, d, 10, 1.35, 0.72, False, 1.0))


@query(
    f"""
WITH p AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_CODE_TOKENS}) AS token FROM documents) GROUP BY ALL)
SELECT token, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 6) AS idf FROM p GROUP BY token"""
)
def a3_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("did"), T.code_tokens(F.col("text")).alias("tokens"))
    postings = R.term_counts(d, "did")
    counts = postings.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return counts.join(R.idf_table(postings, d.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avg_len"))), "token").select("token", "df", "cf", F.round("idf", 6).alias("idf"))


@query(
    r"""
WITH q AS (SELECT item_id AS qid, token, sqrt(count(*)::DOUBLE) AS w FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark) GROUP BY ALL),
d AS (SELECT doc_id AS did, token, sqrt(count(*)::DOUBLE) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY ALL),
s AS (SELECT qid, did, sum(q.w * d.w) AS score FROM q JOIN d USING (token) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, did) AS rank FROM s)
SELECT qid, did, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""
)
def j2_sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = (table(spark, sf_dir, name).select(F.col(key).alias(alias), T.all_matches(F.lower("text"), "[a-z0-9]+").alias("tokens")) for name, key, alias in (("benchmark", "item_id", "qid"), ("documents", "doc_id", "did")))
    return _shown(TS.root_count_top_k(q, d, 10))


def _vectors(spark: SparkSession, sf_dir: str, dims: int = 64) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.slice("embedding", 1, dims).alias("v"))
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "v"), e.select(F.col("vec_id").alias("did"), "v")


def _dense(spark: SparkSession, sf_dir: str, k: int, dims: int = 64) -> DataFrame:
    return R.dense_top_k(*_vectors(spark, sf_dir, dims), k)


_PAIRS = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings),
pairs AS (SELECT q.vec_id AS qid, d.vec_id AS did, list_dot_product(q.v, d.v) AS s1, list_dot_product(q.v[1:16], d.v[1:16]) AS s2, (q.label = d.label)::INT AS rel
          FROM e q JOIN e d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s1, 8) DESC, did) AS r1, row_number() OVER (PARTITION BY qid ORDER BY round(s2, 8) DESC, did) AS r2 FROM pairs)
"""


@query(_PAIRS + "SELECT qid, did, round(s1, 6) AS score, r1 AS rank FROM ranked WHERE r1 <= 10")
def j4_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_dense(spark, sf_dir, 10))


@query(_PAIRS + "SELECT qid, did, round(s2, 6) AS score, r2 AS rank FROM ranked WHERE r2 <= 20")
def l1_merge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = _vectors(spark, sf_dir, 16)
    return _shown(R.merge_top_k([R.dense_top_k(q, d.where("did % 2 = 0"), 20), R.dense_top_k(q, d.where("did % 2 = 1"), 20)], 20))


_LAST = ", row_number() OVER (PARTITION BY qid ORDER BY round(score, {n}) DESC, did) AS rank FROM {t}) SELECT qid, did, round(score, {d}) AS score, rank FROM z WHERE rank <= 10"


@query(_PAIRS + ", u AS (SELECT qid, did, 0.7::DOUBLE * CASE WHEN r1 <= 20 THEN s1 ELSE 0 END + 0.3::DOUBLE * CASE WHEN r2 <= 20 THEN s2 ELSE 0 END AS score FROM ranked WHERE r1 <= 20 OR r2 <= 20), z AS (SELECT *" + _LAST.format(n=8, d=6, t="u"))
def j3_gather_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(R.gather_candidates(_dense(spark, sf_dir, 20), _dense(spark, sf_dir, 20, 16), 0.7, 0.3, 10))


@query(_PAIRS + ", u AS (SELECT qid, did, sum(p) AS score FROM (SELECT qid, did, 1.0::DOUBLE / (60 + r1) AS p FROM ranked WHERE r1 <= 20 UNION ALL SELECT qid, did, 0.5::DOUBLE / (60 + r2) FROM ranked WHERE r2 <= 20) GROUP BY ALL), z AS (SELECT *" + _LAST.format(n=12, d=9, t="u"))
def w6_weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(fuse.reciprocal_rank_fusion([_dense(spark, sf_dir, 20), _dense(spark, sf_dir, 20, 16)], [1.0, 0.5]), 9)


def _scored(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    """Candidates of the full surface with both scores and whether they are relevant: qid, did, s1, s2, label."""
    e = table(spark, sf_dir, "embeddings")
    run = _dense(spark, sf_dir, k).select("qid", "did", F.round("score", 8).alias("s1"))
    small = e.select(F.col("vec_id").alias("did"), F.slice("embedding", 1, 16).alias("dv"), F.col("label").alias("dl"))
    own = e.select(F.col("vec_id").alias("qid"), F.slice("embedding", 1, 16).alias("qv"), F.col("label").alias("ql"))
    both = run.join(own, "qid").join(small, "did")
    return both.select("qid", "did", "s1", F.round(A.dot(F.col("qv"), F.col("dv")), 8).alias("s2"), (F.col("ql") == F.col("dl")).cast("int").alias("label"))


_SCORED = _PAIRS + ", scored AS (SELECT qid, did, round(s1, 8) AS s1, round(s2, 8) AS s2, rel AS label FROM ranked WHERE r1 <= 50)"


@query(_SCORED + ", u AS (SELECT qid, did, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY qid ORDER BY s2 DESC, did)) + 0.3::DOUBLE / (60 + row_number() OVER (PARTITION BY qid ORDER BY s1 DESC, did)) AS score FROM scored), z AS (SELECT *" + _LAST.format(n=12, d=9, t="u"))
def w7_rerank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = 1.0 / (60 + fuse.rank_of(F.col("s2"))) + 0.3 / (60 + fuse.rank_of(F.col("s1")))
    return _shown(R.top_k(_scored(spark, sf_dir).select("qid", "did", score.alias("score")), 10, 12), 9)


@query(_SCORED + " SELECT qid, did, round(1 / (60 + rank() OVER (PARTITION BY qid ORDER BY round(s1, 1) DESC) + (count(*) OVER (PARTITION BY qid, round(s1, 1)) - 1) / 2::DOUBLE), 9) AS feature FROM scored")
def w8_midrank_reciprocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("coarse", F.round("s1", 1))
    return rows.select("qid", "did", F.round(fuse.midrank_reciprocal(F.col("coarse")), 9).alias("feature"))


@query(_SCORED + " SELECT qid, did, round((s1 - avg(s1) OVER w) / stddev_pop(s1) OVER w + 0.25::DOUBLE * (s2 - avg(s2) OVER w) / stddev_pop(s2) OVER w, 6) AS blend FROM scored WINDOW w AS (PARTITION BY qid)")
def w9_zscore_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("qid", "did", F.round(fuse.zscore(F.col("s1")) + 0.25 * fuse.zscore(F.col("s2")), 6).alias("blend"))


@query(_SCORED + " SELECT qid, did, round(0.65::DOUBLE * (s2 - min(s2) OVER w) / (max(s2) OVER w - min(s2) OVER w) + 0.35::DOUBLE * (s1 - min(s1) OVER w) / (max(s1) OVER w - min(s1) OVER w), 6) AS blend FROM scored WINDOW w AS (PARTITION BY qid)")
def w10_minmax_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("qid", "did", F.round(fuse.blended(F.col("s1"), F.col("s2"), F.lit(0.65), "minmax"), 6).alias("blend"))


def _judged(spark: SparkSession, sf_dir: str, run: DataFrame, plain: str = "qid") -> tuple[DataFrame, DataFrame]:
    """``run`` (with a column ``plain``, its vector's id, and did) with ``hit``, whether both have one label; and (vec_id, n): the number of others of each vector's label.

    Only the run's own rows are looked up: relevant pairs are never listed.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    sizes = e.join(e.groupBy("label").agg((F.count("*") - 1).alias("n")), "label").select("vec_id", "n")
    own, other = e.select(F.col("vec_id").alias(plain), F.col("label").alias("ql")), e.select(F.col("vec_id").alias("did"), F.col("label").alias("dl"))
    return run.join(own, plain).join(other, "did").withColumn("hit", (F.col("ql") == F.col("dl")).cast("int")).drop("ql", "dl"), sizes


def _run_metrics(spark: SparkSession, sf_dir: str, run: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    judged, sizes = _judged(spark, sf_dir, run)
    return M.judged_metrics(judged, sizes.withColumnRenamed("vec_id", "qid"), queries if queries is not None else run.select("qid").distinct())


def _keyed_metrics(spark: SparkSession, sf_dir: str, runs: DataFrame, key: str) -> DataFrame:
    """Metrics of runs (qid, plain, did, rank and a key that qid holds too), with plain and the key."""
    keys = runs.select("qid", "plain", key).distinct()
    judged, sizes = _judged(spark, sf_dir, runs, "plain")
    return M.judged_metrics(judged, keys.join(sizes.withColumnRenamed("vec_id", "plain"), "plain").select("qid", "n"), keys.select("qid")).join(keys, "qid")


def _rounded(df: DataFrame, *kept: str) -> DataFrame:
    return df.select(*kept, *(F.round(c, 6).alias(c) for c in df.columns if c not in kept))


def _metric_sql(run: str, keys: str = "qid") -> str:
    """CTEs from ``run`` (keys, did, label, rank) and ``sizes`` (qid, n) to ``m``, a row per query."""
    return f"""
, hits AS (SELECT *, sum(label) OVER (PARTITION BY {keys} ORDER BY rank) AS found FROM {run} WHERE rank <= 10),
g AS (SELECT {keys}, sum(label / log2(rank + 1)) AS dcg, sum(CASE WHEN label = 1 THEN found / rank::DOUBLE ELSE 0 END) AS precisions, max(CASE WHEN label = 1 THEN 1 / rank::DOUBLE ELSE 0 END) AS mrr, sum(label) AS hits FROM hits GROUP BY {keys}),
m AS (SELECT {', '.join('g.' + k.strip() for k in keys.split(','))}, CASE WHEN n > 0 THEN dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 10)::BIGINT + 1) t(i)) ELSE 0 END AS ndcg, CASE WHEN n > 0 THEN precisions / least(n, 10) ELSE 0 END AS map, mrr,
  CASE WHEN n > 0 THEN hits / n::DOUBLE ELSE 0 END AS recall, hits / 10::DOUBLE AS precision, (hits > 0)::INT::DOUBLE AS hit_rate FROM g JOIN sizes USING (qid))"""


_SIZES = ", sizes AS (SELECT qid, sum(rel) AS n FROM pairs GROUP BY qid)"
_RUN = ", run AS (SELECT qid, did, rel AS label, r1 AS rank FROM ranked WHERE r1 <= 50)"


@query(_PAIRS + _SIZES + _RUN + _metric_sql("run") + " SELECT qid, round(ndcg, 6) AS ndcg, round(map, 6) AS map, round(mrr, 6) AS mrr, round(recall, 6) AS recall, round(precision, 6) AS precision, round(hit_rate, 6) AS hit_rate, false AS missing FROM m")
def a12_metrics_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_run_metrics(spark, sf_dir, _dense(spark, sf_dir, 50)), "qid", "missing")


@query(
    """
WITH qrels AS (SELECT b.item_id AS qid, d.doc_id AS did FROM benchmark b JOIN documents d ON contains(d.text, b.text)), sizes AS (SELECT item_id AS qid, count(did)::INT AS n FROM benchmark LEFT JOIN qrels ON qid = item_id GROUP BY item_id),
p AS (SELECT item_id AS qid, token FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM benchmark)),
w AS (SELECT doc_id AS did, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM documents),
o AS (SELECT qid, did, count(*) AS score FROM p JOIN w USING (token) GROUP BY ALL),
run AS (SELECT o.qid, o.did, (r.did IS NOT NULL)::INT AS label, row_number() OVER (PARTITION BY o.qid ORDER BY score DESC, o.did) AS rank FROM o LEFT JOIN qrels r ON r.qid = o.qid AND r.did = o.did)"""
    + _metric_sql("run")
    + " SELECT count(*)::BIGINT AS queries, (SELECT count(*) FROM benchmark)::BIGINT - count(*)::BIGINT AS missing_queries, round(avg(ndcg), 6) AS ndcg, round(avg(map), 6) AS map, round(avg(mrr), 6) AS mrr, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(hit_rate), 6) AS hit_rate FROM m"
)
def j5_a10_evaluate_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-overlap run of the benchmark, judged by containment; items that no document contains score 0."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    qrels = R.containing(items.select(F.col("item_id").alias("qid"), "text"), docs.select(F.col("doc_id").alias("did"), "text"))
    words = lambda df, key, alias: df.select(F.col(key).alias(alias), F.explode(F.array_distinct(T.all_matches(F.lower("text"), "[a-z0-9]+"))).alias("token"))
    overlap = words(items, "item_id", "qid").join(words(docs, "doc_id", "did"), "token").groupBy("qid", "did").agg(F.count("*").cast("double").alias("score"))
    out = M.mean_metrics(M.run_metrics(R.top_k(overlap, 10), qrels, items.select(F.col("item_id").alias("qid"))))
    return _rounded(out, "queries", "missing_queries")


_TIED = _SCORED + ", t AS (SELECT qid, label, round(s1, 1) AS score FROM scored), b AS (SELECT qid, score, count(*) AS size, sum(label) AS hits, avg(pow(2, label) - 1) AS gain FROM t GROUP BY ALL), c AS (SELECT *, coalesce(sum(size) OVER w, 0) AS seen, coalesce(sum(hits) OVER w, 0) AS before FROM b WINDOW w AS (PARTITION BY qid ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), o AS (SELECT *, unnest(range(1, size + 1)) AS o FROM c)"
_COMB = "exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"


@query(
    _TIED
    + ", x AS (SELECT qid, hits, before, size, seen, score, sum((hits / size::DOUBLE) * (before + 1 + CASE WHEN size > 1 THEN (o - 1) * (hits - 1) / (size - 1)::DOUBLE ELSE 0 END) / (seen + o)) AS ap, "
    + f"sum(CASE WHEN hits > 0 AND o <= size - hits + 1 THEN {_COMB.format(n='(size - o)', k='(hits - 1)')} / {_COMB.format(n='size', k='hits')} / (seen + o) ELSE 0 END) AS rr, sum(CASE WHEN seen + o <= 10 THEN gain / log2(seen + o + 1) ELSE 0 END) AS dcg FROM o GROUP BY ALL)"
    + ", y AS (SELECT qid, sum(CASE WHEN hits > 0 THEN ap ELSE 0 END) AS p, sum(hits) AS n, max(CASE WHEN hits > 0 AND before = 0 THEN rr ELSE 0 END) AS mrr, sum(dcg) AS dcg FROM x GROUP BY qid), i AS (SELECT qid, sum((pow(2, label) - 1) / log2(r + 1)) AS ideal FROM (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY label DESC) AS r FROM t) WHERE r <= 10 GROUP BY qid)"
    + " SELECT qid, round(CASE WHEN n > 0 THEN p / n ELSE 0 END, 6) AS map, round(mrr, 6) AS mrr, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM y JOIN i USING (qid)"
)
def a13_tie_aware_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).select("qid", "label", F.round("s1", 1).alias("score"))
    return _rounded(M.tie_aware_metrics(scored), "qid")


@query(_SCORED + " SELECT qid, round(max(s1) - max(CASE WHEN r = 2 THEN s1 END), 6) AS top_margin, round(coalesce(min(CASE WHEN label > 0 THEN s1 END) - max(CASE WHEN label <= 0 THEN s1 END), 0), 6) AS positive_margin FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s1 DESC) AS r FROM scored) GROUP BY qid")
def a15_a16_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).withColumnRenamed("s1", "score")
    both = M.top_margin(scored).withColumnRenamed("margin", "top_margin").join(M.least_positive_margin(scored).withColumnRenamed("margin", "positive_margin"), "qid")
    return _rounded(both, "qid")


@query(_SCORED + " SELECT qid, did, round(CASE WHEN m <= 0.05 THEN s2 ELSE s1 END, 6) AS score FROM (SELECT *, max(s1) OVER w - (nth_value(s1, 2) OVER (PARTITION BY qid ORDER BY s1 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS m FROM scored WINDOW w AS (PARTITION BY qid))")
def w12_margin_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    margins = M.top_margin(scored.withColumnRenamed("s1", "score"))
    return scored.join(margins, "qid").select("qid", "did", F.round(fuse.gate(F.col("s1"), F.col("s2"), F.col("margin"), 0.05), 6).alias("score"))


_GRID = "[" + ", ".join(f"{a / 10}" for a in range(11)) + "]"
_ALPHAS = [a / 10 for a in range(11)]


def _grid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the blended candidates for every alpha."""
    grid = _scored(spark, sf_dir).withColumn("alpha", F.explode(F.array(*map(F.lit, _ALPHAS))))
    key = F.concat_ws(":", "qid", "alpha")
    blended = grid.withColumn("key", key).withColumn("score", F.col("alpha") * fuse.minmax(F.col("s2"), "key") + (1 - F.col("alpha")) * fuse.minmax(F.col("s1"), "key"))
    order = Window.partitionBy("key").orderBy(F.round("score", 8).desc(), "did")
    return blended.withColumn("rank", F.row_number().over(order))


_GRID_SQL = (
    _SCORED
    + _SIZES
    + f", n AS (SELECT *, (s1 - min(s1) OVER w) / (max(s1) OVER w - min(s1) OVER w) AS n1, (s2 - min(s2) OVER w) / (max(s2) OVER w - min(s2) OVER w) AS n2 FROM scored WINDOW w AS (PARTITION BY qid)), grid AS (SELECT qid, did, label, alpha, row_number() OVER (PARTITION BY qid, alpha ORDER BY round(alpha * n2 + (1 - alpha) * n1, 8) DESC, did) AS rank FROM n, (SELECT unnest({_GRID}::DOUBLE[]) AS alpha))"
    + _metric_sql("grid", "qid, alpha")
)


def _grid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _grid_runs(spark, sf_dir).withColumn("plain", F.col("qid")).withColumn("qid", F.col("key"))
    return _keyed_metrics(spark, sf_dir, runs, "alpha")


@query(_GRID_SQL + " SELECT alpha, count(*)::BIGINT AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(map), 6) AS map, round(avg(mrr), 6) AS mrr, round(avg(recall), 6) AS recall FROM m GROUP BY alpha")
def w11_alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.mean_metrics(_grid_metrics(spark, sf_dir), "alpha")
    return _rounded(out.select("alpha", "queries", "ndcg", "map", "mrr", "recall"), "alpha", "queries")


@query(_GRID_SQL + ", f AS (SELECT alpha, (qid // 20) % 2 AS half, round(avg(ndcg), 8) AS ndcg FROM m GROUP BY ALL), best AS (SELECT max_by(alpha, (ndcg, -abs(alpha - 1))) AS alpha FROM f WHERE half = 0) SELECT alpha, round(ndcg, 6) AS held_out_ndcg FROM f JOIN best USING (alpha) WHERE half = 1")
def l14_h16_tune_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alpha that is best on even queries, judged on odd ones."""
    halves = _grid_metrics(spark, sf_dir).withColumn("half", F.expr("(plain div 20) % 2")).groupBy("alpha", "half").agg(F.round(F.avg("ndcg"), 8).alias("ndcg"))
    best = halves.where("half = 0").agg(F.max_by("alpha", F.struct("ndcg", -F.abs(F.col("alpha") - 1))).alias("alpha"))
    return halves.where("half = 1").join(best, "alpha").select("alpha", F.round("ndcg", 6).alias("held_out_ndcg"))


@query(
    _GRID_SQL
    + ", f AS (SELECT *, (qid // 20) % 5 AS fold FROM m), v AS (SELECT b.fold, a.alpha, round(avg(a.map), 8) AS train FROM f a, (SELECT DISTINCT fold FROM f) b WHERE a.fold <> b.fold GROUP BY ALL), s AS (SELECT fold, max_by(alpha, (train, -alpha)) AS alpha FROM v GROUP BY fold)"
    + " SELECT fold::BIGINT AS fold, alpha, round(avg(map), 6) AS held_out_map FROM f JOIN s USING (fold, alpha) GROUP BY ALL"
)
def l12_nested_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of five folds, the alpha that is best on the others, judged on it."""
    by_fold = _grid_metrics(spark, sf_dir).withColumn("fold", F.expr("(plain div 20) % 5")).groupBy("alpha", "fold").agg(F.sum("map").alias("s"), F.count("*").alias("n"))
    other = by_fold.select("alpha", F.col("fold").alias("f"), "s", "n").join(by_fold.select("fold").distinct(), F.col("f") != F.col("fold"))
    train = other.groupBy("fold", "alpha").agg(F.round(F.sum("s") / F.sum("n"), 8).alias("train"))
    chosen = train.groupBy("fold").agg(F.max_by("alpha", F.struct("train", -F.col("alpha"))).alias("alpha"))
    return by_fold.join(chosen, ["fold", "alpha"]).select(F.col("fold").cast("long").alias("fold"), "alpha", F.round(F.col("s") / F.col("n"), 6).alias("held_out_map"))


_WEIGHTS = "(VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for n, (a, b, c) in fuse.SURFACES.items()) + ") w(surface, a, b, c)"


@query(_SCORED + _SIZES + f", grid AS (SELECT qid, did, label, surface, row_number() OVER (PARTITION BY qid, surface ORDER BY round(a * s1 + b * s2 + c * s1 * s2, 8) DESC, did) AS rank FROM scored, {_WEIGHTS})" + _metric_sql("grid", "qid, surface") + " SELECT surface, round(avg(ndcg), 6) AS ndcg, round(avg(map), 6) AS map FROM m GROUP BY surface")
def j8_weight_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    each = F.array(*(F.struct(F.lit(n).alias("surface"), fuse.fused(F.col("s1"), F.col("s2"), F.col("s1") * F.col("s2"), w).alias("score")) for n, w in fuse.SURFACES.items()))
    grid = scored.select("qid", "did", F.explode(each).alias("e")).select("did", "e.surface", "e.score", F.col("qid").alias("plain"), F.concat_ws(":", "qid", "e.surface").alias("qid"))
    out = _keyed_metrics(spark, sf_dir, R.top_k(grid, 10), "surface").groupBy("surface").agg(F.avg("ndcg").alias("ndcg"), F.avg("map").alias("map"))
    return _rounded(out, "surface")


@query(_PAIRS + _SIZES + ", two AS (SELECT qid, did, rel AS label, r1 AS rank, 'base' AS model FROM ranked UNION ALL SELECT qid, did, rel, r2, 'student' FROM ranked)" + _metric_sql("two", "qid, model") + ", d AS (SELECT a.qid, b.ndcg - a.ndcg AS delta FROM m a JOIN m b ON a.qid = b.qid AND a.model = 'base' AND b.model = 'student') SELECT count(*)::BIGINT AS queries, round(avg(delta), 6) AS mean_delta, round(min(delta), 6) AS min_delta, round(max(delta), 6) AS max_delta, count(*) FILTER (round(delta, 9) >= 0)::BIGINT AS passes, count(*) FILTER (round(delta, 9) < 0)::BIGINT AS regressions FROM d")
def j7_a23_compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _vectors(spark, sf_dir)[0].select("qid")
    base = _run_metrics(spark, sf_dir, _dense(spark, sf_dir, 10), q).select("qid", F.col("ndcg").alias("a"))
    student = _run_metrics(spark, sf_dir, _dense(spark, sf_dir, 10, 16), q).select("qid", F.col("ndcg").alias("b"))
    delta = base.join(student, "qid").select((F.col("b") - F.col("a")).alias("delta"))
    near = F.round("delta", 9)
    return delta.agg(
        F.count("*").alias("queries"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.round(F.min("delta"), 6).alias("min_delta"), F.round(F.max("delta"), 6).alias("max_delta"), F.count_if(near >= 0).alias("passes"), F.count_if(near < 0).alias("regressions")
    )


@query(_SCORED + ", x AS (SELECT qid, s1 / 0.05::DOUBLE AS z, max(s1) OVER (PARTITION BY qid) / 0.05::DOUBLE AS m FROM scored), p AS (SELECT qid, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY qid) AS p FROM x) SELECT qid, round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy, round(max(p), 6) AS top FROM p GROUP BY qid")
def m1_m2_softmax_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_query = _scored(spark, sf_dir).groupBy("qid").agg(F.array_sort(F.collect_list("s1")).alias("s"))
    p = by_query.withColumn("p", A.softmax(F.col("s"), 0.05))
    return p.select("qid", F.round(A.normalized_entropy(F.col("p")), 6).alias("entropy"), F.round(F.array_max("p"), 6).alias("top"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, round(embedding[1]::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12), 6) AS first FROM embeddings")
def m12_l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(A.dot(v, v)), 4).alias("norm"), F.round(F.element_at(A.l2_normalize(v), 1), 6).alias("first"))


_SUB = "list_slice(v, {i} * 16 + 1, {i} * 16 + 16)"


@query(
    "WITH t AS (SELECT vec_id, i, list_slice(list_transform(embedding, lambda x: x::DOUBLE), i * 16 + 1, i * 16 + 16) AS v FROM embeddings, range(4) r(i)), b AS (SELECT q.vec_id AS qid, d.vec_id AS did, q.i, max(list_dot_product(q.v, d.v)) AS best FROM t q JOIN t d ON q.vec_id % 20 = 0 AND q.i > 0 AND d.vec_id <> q.vec_id GROUP BY ALL),"
    " s AS (SELECT qid, did, avg(best) AS score FROM b GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, did) AS rank FROM s) SELECT qid, did, round(score, 6) AS score FROM r WHERE rank <= 10"
)
def h12_late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten of all vectors for each query, by late interaction of four token vectors."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("did"), F.col("embedding").cast("array<double>").alias("v"))
    best = R.late_interaction_top_k(e.where("did % 20 = 0").withColumnRenamed("did", "qid"), e, 10, 16)
    return best.select("qid", "did", F.round("score", 6).alias("score"))
