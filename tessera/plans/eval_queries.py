"""Queries of the retrieval lab: cases, candidates, teacher rows, splits, comparisons, parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import completions as CO
from tessera.functions import params as PA
from tessera.operators import lab as LB
from tessera.operators import metrics as M
from tessera.plans.lab_queries import _ROWS, _fraction, _rows
from tessera.plans.registry import query, table
from tessera.plans.retrieval_queries import _SCORED, _scored

# Items as cases with three expected parts each; pages as search results of the first 40.
_CASES = "WITH r AS (SELECT page_id % 40 AS name, page_id // 40 + 1 AS rank, url FROM pages), e AS (SELECT item_id AS name, unnest(['/en/', 'example.org', 'h' || item_id % 3]) AS part FROM benchmark)"
_MATCHED = _CASES + ", m AS (SELECT e.name, part, min(CASE WHEN contains(url, rtrim(part, '/')) THEN rank END) AS rank FROM e LEFT JOIN r ON r.name = e.name AND rank <= 3 GROUP BY ALL), c AS (SELECT name, round_even(count(rank) / 3::DOUBLE, 4) AS recall_at_k, count(rank) > 0 AS hit, round_even(coalesce(1 / min(rank)::DOUBLE, 0), 4) AS mrr FROM m GROUP BY name)"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.array(F.lit("/en/"), F.lit("example.org"), F.concat(F.lit("h"), F.col("item_id") % 3))
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("name"), expected.alias("expected"))
    results = table(spark, sf_dir, "pages").select((F.col("page_id") % 40).alias("name"), F.expr("page_id div 40 + 1").alias("rank"), "url")
    return LB.evaluate_cases(cases, results, 3)


@query(_MATCHED + " SELECT * FROM c")
def a9_evaluate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item is a case of the suite."""
    return _cases(spark, sf_dir)


@query(_MATCHED + " SELECT count(*)::BIGINT AS cases, round_even(avg(recall_at_k), 4) AS recall_at_k, round_even(avg(hit::INT), 4) AS hit_rate, round_even(avg(mrr), 4) AS mrr FROM c")
def a9_suite_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LB.suite_means(_cases(spark, sf_dir))


@query(_SCORED + " SELECT qid, array_to_string(list(label ORDER BY did), ',') AS labels, round(list_sum(list(s1 ORDER BY did)), 6) AS total, count(*)::INT AS n FROM scored GROUP BY qid")
def h1_grouped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = LB.grouped_scores(_scored(spark, sf_dir).withColumnRenamed("s1", "score"))
    return rows.select("qid", F.array_join("labels", ",").alias("labels"), F.round(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("scores").alias("n"))


def _tied_sql(scored: str, key: str) -> str:
    """CTEs from ``scored`` (key, label, score) to ``m``: expected MAP, MRR and nDCG at 10 by key, over all orders of equal scores."""
    comb = "exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"
    return f""", tb AS (SELECT {key}, score, count(*) AS size, sum((label > 0)::INT) AS hits, avg(pow(2, label) - 1) AS gain FROM {scored} GROUP BY ALL),
tc AS (SELECT *, coalesce(sum(size) OVER w, 0) AS seen, coalesce(sum(hits) OVER w, 0) AS before FROM tb WINDOW w AS (PARTITION BY {key} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), tp AS (SELECT *, unnest(range(1, size + 1)) AS o FROM tc),
tx AS (SELECT {key}, hits, before, size, seen, score, sum((hits / size::DOUBLE) * (before + 1 + CASE WHEN size > 1 THEN (o - 1) * (hits - 1) / (size - 1)::DOUBLE ELSE 0 END) / (seen + o)) AS ap,
 sum(CASE WHEN hits > 0 AND o <= size - hits + 1 THEN {comb.format(n='(size - o)', k='(hits - 1)')} / {comb.format(n='size', k='hits')} / (seen + o) ELSE 0 END) AS rr, sum(CASE WHEN seen + o <= 10 THEN gain / log2(seen + o + 1) ELSE 0 END) AS dcg FROM tp GROUP BY ALL),
ty AS (SELECT {key}, sum(CASE WHEN hits > 0 THEN ap ELSE 0 END) AS p, sum(hits) AS n, max(CASE WHEN hits > 0 AND before = 0 THEN rr ELSE 0 END) AS mrr, sum(dcg) AS dcg FROM tx GROUP BY {key}),
ti AS (SELECT {key}, sum((pow(2, label) - 1) / log2(r + 1)) AS ideal FROM (SELECT {key}, label, row_number() OVER (PARTITION BY {key} ORDER BY label DESC) AS r FROM {scored}) WHERE r <= 10 GROUP BY {key}),
m AS (SELECT {key}, CASE WHEN n > 0 THEN p / n ELSE 0 END AS map, mrr, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END AS ndcg FROM ty JOIN ti USING ({key}))"""


_MEANS = "round(avg(map), 6) AS map, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg"


def _mean(df: DataFrame, *kept: str) -> DataFrame:
    return df.select(*kept, *(F.round(m, 6).alias(m) for m in LB.METRICS))


@query(_SCORED + ", half AS (SELECT qid, label, s1 AS score FROM scored WHERE qid % 40 = 0)" + _tied_sql("half", "qid") + f" SELECT count(*)::BIGINT AS queries, {_MEANS} FROM m")
def a14_subset_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fold: queries divisible by 40."""
    scored = _scored(spark, sf_dir).withColumnRenamed("s1", "score")
    return _mean(LB.subset_metrics(scored, scored.where("qid % 40 = 0").select("qid")), "queries")


_BLENDS = [("s2", 0.2), ("s3", 0.05)]
_CANDIDATES = (
    _SCORED
    + ", wide AS (SELECT qid, did, label, s1, (s1 - avg(s1) OVER w) / stddev_pop(s1) OVER w AS z1, (s2 - avg(s2) OVER w) / stddev_pop(s2) OVER w AS z2, (did % 7 - avg(did % 7) OVER w) / stddev_pop(did % 7) OVER w AS z3 FROM scored WINDOW w AS (PARTITION BY qid)),"
    " cand AS (SELECT 'model' AS candidate, qid, did, label, s1 AS score FROM wide UNION ALL SELECT 's2_alpha_0.2', qid, did, label, round(z1 + 0.2::DOUBLE * z2, 9) FROM wide UNION ALL SELECT 's3_alpha_0.05', qid, did, label, round(z1 + 0.05::DOUBLE * z3, 9) FROM wide)"
)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).withColumn("s3", (F.col("did") % 7).cast("double")).withColumnRenamed("s1", "score")
    return LB.candidate_scores(scored, _BLENDS).withColumn("score", F.round("score", 9))


@query(_CANDIDATES + ", keyed AS (SELECT candidate || ':' || qid AS k, label, score FROM cand)" + _tied_sql("keyed", "k") + f" SELECT split_part(k, ':', 1) AS candidate, count(*)::BIGINT AS queries, {_MEANS} FROM m GROUP BY 1")
def h3_candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mean(LB.candidate_metrics(_candidates(spark, sf_dir)), "candidate", "queries")


_SHARES = [0.25, 0.5]


@query(
    _CANDIDATES
    + """, mg AS (SELECT qid, max(s1) - max(CASE WHEN r = 2 THEN s1 END) AS margin FROM (SELECT qid, s1, row_number() OVER (PARTITION BY qid ORDER BY s1 DESC) AS r FROM scored) GROUP BY qid),
th AS (SELECT DISTINCT round(t, 9) AS t FROM (SELECT unnest([quantile_cont(margin, 0.25), quantile_cont(margin, 0.5)]) AS t FROM mg)),
gated AS (SELECT a.candidate || '|' || b.candidate || '|' || round(t, 6) AS c, 'low_margin_gate' AS method, (margin <= t)::INT AS g, a.qid, a.label, CASE WHEN margin <= t THEN b.score ELSE a.score END AS score FROM cand a JOIN cand b USING (qid, did) JOIN mg USING (qid), th WHERE a.candidate <> b.candidate
 UNION ALL SELECT candidate || '||', 'direct', 0, qid, label, score FROM cand),
keyed AS (SELECT c || ':' || qid AS k, label, score FROM gated)"""
    + _tied_sql("keyed", "k")
    + f", counts AS (SELECT c, any_value(method) AS method, sum(g)::BIGINT AS gated FROM (SELECT DISTINCT c, method, g, qid FROM gated) GROUP BY c) SELECT c AS candidate, method, gated, {_MEANS} FROM m JOIN counts ON c = split_part(k, ':', 1) GROUP BY ALL"
)
def l13_search_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).withColumnRenamed("s1", "score")
    margins = M.top_margin(scored)
    found = LB.search_candidates(_candidates(spark, sf_dir), margins, LB.margin_thresholds(margins, _SHARES))
    name = F.concat_ws("|", "base", F.coalesce("alternate", F.lit("")), F.coalesce(F.round("threshold", 6).cast("string"), F.lit("")))
    return _mean(found, "method", F.col("gated"), name.alias("candidate"))


@query(_SCORED + ", n AS (SELECT *, (s1 - min(s1) OVER w) / (max(s1) OVER w - min(s1) OVER w) AS n1, (s2 - min(s2) OVER w) / (max(s2) OVER w - min(s2) OVER w) AS n2 FROM scored WINDOW w AS (PARTITION BY qid)), b AS (SELECT qid, label, round(0.65::DOUBLE * n2 + 0.35::DOUBLE * n1, 9) AS score FROM n)" + _tied_sql("b", "qid") + f" SELECT count(*)::BIGINT AS queries, {_MEANS} FROM m")
def h4_evaluate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened records, two scores, their blend, and the metrics of it."""
    from tessera.operators import fusion as fuse

    blended = _scored(spark, sf_dir).select("qid", "label", F.round(fuse.blended(F.col("s1"), F.col("s2"), F.lit(0.65), "minmax"), 9).alias("score"))
    return _mean(LB.mean_tied(M.tie_aware_metrics(blended)), "queries")


_SUMMARY = _ROWS + ", b AS (SELECT *, len(pos) > 0 AND len(neg) > 0 AS sides FROM rows), x AS (SELECT *, CASE WHEN sides THEN list_max(pos) - list_max(neg) END AS margin, CASE WHEN sides THEN list_max(pos2) - list_max(neg2) END AS old FROM b)"


@query(
    _SUMMARY
    + """ SELECT count(margin)::BIGINT AS rows_with_scores, sum(len(pos))::BIGINT AS positive_pairs, sum(len(neg))::BIGINT AS negative_pairs, round(sum(list_sum(pos)) / sum(len(pos)), 6) AS mean_positive, round(sum(list_sum(neg)) / sum(len(neg)), 6) AS mean_negative, round(avg(margin), 6) AS mean_margin,
 round(avg(CASE WHEN sides THEN list_avg(pos) - list_avg(neg) END), 6) AS mean_row_difference, count(*) FILTER (margin > 0)::BIGINT AS best_wins, round(count(*) FILTER (margin > 0) / count(margin)::DOUBLE, 6) AS best_win_rate, count(*) FILTER (sides AND list_min(pos) > list_max(neg))::BIGINT AS all_win, round(corr(old, margin), 6) AS margin_correlation FROM x"""
)
def a20_teacher_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = LB.teacher_summary(_rows(spark, sf_dir).withColumnsRenamed({"pos2": "old_pos", "neg2": "old_neg"}))
    rounded = lambda *names: [F.round(n, 6).alias(n) for n in names]
    return s.select("rows_with_scores", F.col("positive_pairs").cast("long"), F.col("negative_pairs").cast("long"), *rounded("mean_positive", "mean_negative", "mean_margin", "mean_row_difference"), "best_wins", *rounded("best_win_rate"), "all_win", *rounded("margin_correlation"))


@query(_ROWS + ", r AS (SELECT key, CASE WHEN key % 3 = 0 THEN [] ELSE pos2 END AS op, CASE WHEN key % 5 = 0 THEN [] ELSE neg2 END AS oneg, pos, neg FROM rows) SELECT key, round(coalesce(list_max(CASE WHEN len(op) > 0 AND len(oneg) > 0 THEN op ELSE pos END), 0), 8) AS p, round(coalesce(list_max(CASE WHEN len(op) > 0 AND len(oneg) > 0 THEN oneg ELSE neg END), 0), 8) AS n FROM r")
def h7_reranker_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<double>")
    rows = _rows(spark, sf_dir).withColumn("op", F.when(F.col("key") % 3 != 0, F.col("pos2"))).withColumn("oneg", F.when(F.col("key") % 5 == 0, none).otherwise(F.col("neg2")))
    pos, neg = LB.reranker_scores(F.col("op"), F.col("oneg"), F.col("pos"), F.col("neg"))
    most = lambda c: F.round(F.coalesce(F.array_max(c), F.lit(0.0)), 8)
    return rows.select("key", most(pos).alias("p"), most(neg).alias("n"))


@query(_ROWS + " SELECT key, 'price' AS surface, len(pos)::INT AS p, len(neg)::INT AS n FROM rows WHERE len(pos) > 0 AND len(neg) > 0 UNION ALL SELECT key, 'quantity', len(pos2)::INT, len(neg2)::INT FROM rows WHERE len(pos) > 0 AND len(neg) > 0")
def h8_surface_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score lists by surface, of rows that have both sides on all surfaces."""
    maps = [F.create_map(F.lit("price"), F.col(a), F.lit("quantity"), F.col(b)) for a, b in (("pos", "pos2"), ("neg", "neg2"))]
    rows = _rows(spark, sf_dir).withColumn("s", LB.surface_scores(*maps, ["price", "quantity"])).where("s is not null")
    return rows.select("key", F.inline("s")).select("key", "surface", F.size("pos").alias("p"), F.size("neg").alias("n"))


_TALK = "WITH c AS (SELECT conv_id AS key, list(text ORDER BY turn, text) FILTER (role = 'user') AS pos, list(text ORDER BY turn, text) FILTER (role <> 'user') AS neg FROM conversations GROUP BY conv_id), s AS (SELECT key, 'pos' AS kind, pos AS t, pos[1] AS query FROM c UNION ALL SELECT key, 'neg', neg, pos[1] FROM c)"


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda user: F.transform(F.array_sort(F.collect_list(F.when((F.col("role") == "user") == user, F.struct("turn", "text")))), lambda x: x["text"])
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("key")).agg(side(True).alias("pos"), side(False).alias("neg")).withColumn("query", F.get("pos", F.lit(0)))


@query(_TALK + " SELECT key, kind, unnest(range(len(t)))::INT AS item, md5(query) AS query, md5(unnest(t)) AS text FROM s")
def h9_training_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LB.training_items(_talk(spark, sf_dir)).select("key", "kind", "item", F.md5("query").alias("query"), F.md5("text").alias("text"))


@query(_ROWS + ", p AS (SELECT key, neg, list_transform(range(1, least(len(pos), len(neg)) + 1), lambda i: pos[i] - neg[i]) AS m FROM rows) SELECT count(*)::BIGINT AS rows, sum(len(neg))::BIGINT AS triples, round(sum(list_sum(m)) / sum(len(m)), 6) AS mean, round(min(list_min(m)), 6) AS least, round(max(list_max(m)), 6) AS most, count(*) FILTER (key % 2 = 0)::BIGINT AS with_teacher, count(*)::BIGINT AS with_base FROM p")
def h13_training_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("margins", LB.paired_margins(F.col("pos"), F.col("neg"))).withColumn("teacher_scores", F.when(F.col("key") % 2 == 0, F.col("pos"))).withColumn("base_scores", F.col("neg"))
    return LB.training_summary(rows).select("rows", "triples", *(F.round(c, 6).alias(c) for c in ("mean", "least", "most")), "with_teacher", "with_base")


_COMPARED = "WITH c AS (SELECT l_linestatus AS split, l_returnflag || l_linenumber AS label, avg(l_discount) AS base, avg(l_tax) AS student FROM lineitem GROUP BY ALL), d AS (SELECT *, student - base AS delta FROM c)"


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("split"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("label")).agg(F.avg("l_discount").alias("base"), F.avg("l_tax").alias("student"))
    return rows.withColumn("delta", F.col("student") - F.col("base"))


@query(_COMPARED + " SELECT split, arg_max(label, (round(delta, 12), label)) AS label, round(max(delta), 6) AS delta FROM d GROUP BY split")
def h14_best_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LB.best_delta(_compared(spark, sf_dir), "split").select("split", "label", F.round("delta", 6).alias("delta"))


@query(_COMPARED + " SELECT split, arg_max(label, base) AS base_label, arg_max(label, student) AS student_label, round(max(student) - max(base), 6) AS delta FROM d GROUP BY split")
def h14_best_against_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LB.best_against_best(_compared(spark, sf_dir), "split").select("split", "base_label", "student_label", F.round("delta", 6).alias("delta"))


@query(_COMPARED + " SELECT split, CASE WHEN label LIKE '%1' THEN round(student, 6) WHEN label LIKE '%2' THEN round(base, 6) ELSE 0.5 END AS main, label FROM d")
def h15_first_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics from the first of three places that has some."""
    of = lambda c: F.create_map(F.lit("main"), c)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    found = LB.first_metrics(F.when(F.col("label").endswith("1"), of(F.col("student"))).otherwise(none), F.when(F.col("label").endswith("2"), of(F.col("base"))), of(F.lit(0.5)))
    return _compared(spark, sf_dir).select("split", "label", F.round(found["main"], 6).alias("main"))


@query("WITH g AS (SELECT ['a', 'b'][(l_linenumber % 2 + 1)::INT] AS precision, l_returnflag AS task, avg(l_discount) AS map, avg(l_tax) AS mrr FROM lineitem GROUP BY ALL) SELECT metric, round(avg(CASE WHEN precision = 'a' THEN v END), 6) AS base, round(avg(CASE WHEN precision = 'b' THEN v END), 6) AS other, round(avg(CASE WHEN precision = 'b' THEN v END) - avg(CASE WHEN precision = 'a' THEN v END), 6) AS difference FROM (SELECT precision, 'map' AS metric, map AS v FROM g UNION ALL SELECT precision, 'mrr', mrr FROM g) GROUP BY metric")
def a32_matrix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b").alias("precision"), F.col("l_returnflag").alias("task")).agg(F.avg("l_discount").alias("map"), F.avg("l_tax").alias("mrr"), F.lit("x").alias("digest"))
    return LB.matrix_summary(rows, ["map", "mrr"], "a", "b").select("metric", *(F.round(c, 6).alias(c) for c in ("base", "other", "difference")))


@query(_ROWS + "SELECT CASE WHEN key % 11 = 0 THEN 'split' WHEN len(pos) = 0 THEN 'no_positive' WHEN len(neg) = 0 THEN 'no_negative' WHEN list_max(pos) - list_max(neg) < -1 THEN 'margin' WHEN len(list_filter(neg, lambda x: x > 2)) < 1 THEN 'mix' ELSE 'eligible' END AS reason, count(*)::BIGINT AS n FROM rows GROUP BY 1")
def f19_f23_h5_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why rows are rejected, in the order of the checks."""
    rows = _rows(spark, sf_dir)
    split = LB.training_split(F.when(F.col("key") % 11 == 0, "test").otherwise("train"))
    strata = F.transform("neg", lambda x: F.when(x > 2, "hard").otherwise("easy"))
    checks = [("split", split.isNull()), ("no_positive", F.size("pos") == 0), ("no_negative", F.size("neg") == 0), ("margin", F.array_max("pos") - F.array_max("neg") < -1), ("mix", ~LB.available_mix(strata, {"hard": 1}))]
    return LB.eligible(rows, checks)[1]


@query(_ROWS + "SELECT key, len(pos)::BIGINT AS n_pos, len(neg)::BIGINT AS n_neg, round(coalesce(list_sum(list_transform(range(1, least(len(pos), len(neg)) + 1), lambda i: pos[i] - neg[i])), 0), 8) AS margin FROM rows")
def m13_paired_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    margins = LB.paired_margins(F.col("pos"), F.col("neg"))
    return _rows(spark, sf_dir).select("key", F.size("pos").cast("long").alias("n_pos"), F.size("neg").cast("long").alias("n_neg"), F.round(F.aggregate(margins, F.lit(0.0), lambda a, x: a + x), 8).alias("margin"))


@query(_SCORED + " SELECT qid, did, round(1 / row_number() OVER (PARTITION BY qid ORDER BY s1 DESC, did)::DOUBLE, 6) AS a, round(1 / row_number() OVER (PARTITION BY qid ORDER BY s2 DESC, did)::DOUBLE, 6) AS b FROM scored")
def j6_reciprocal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LB.reciprocal_ranks(_scored(spark, sf_dir), "s1", "s2").select("qid", "did", F.round("s1", 6).alias("a"), F.round("s2", 6).alias("b"))


@query("SELECT l.doc_id, d.doc_id IS NOT NULL AS found, coalesce(length(text), 0)::BIGINT AS n FROM (SELECT doc_id * 3 AS doc_id FROM labels) l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def s11_candidate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "labels").select((F.col("doc_id") * 3).alias("did"))
    texts = LB.wanted_texts(wanted, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("did"), "text"))
    return texts.select(F.col("did").alias("doc_id"), "found", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))


@query("WITH r AS (SELECT l_shipdate, CASE l_returnflag WHEN 'A' THEN NULL ELSE l_quantity END AS a, CASE WHEN l_tax > 0.04 THEN l_discount END AS b, l_tax AS c, l_returnflag AS sheet, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS name FROM lineitem), m AS (SELECT sheet, name, list_avg(list_filter([a, b, c], lambda x: x IS NOT NULL)) AS mean FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY round(mean, 9) DESC, name) AS place FROM m) SELECT sheet, name, round(mean, 6) AS mean, place::INT AS place FROM p WHERE place <= 20")
def a33_row_mean_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 rows of each sheet."""
    cells = F.array(F.when(F.col("l_returnflag") != "A", F.col("l_quantity")), F.when(F.col("l_tax") > 0.04, F.col("l_discount")), F.col("l_tax"))
    name = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sheet"), name.alias("name"), cells.alias("cells"))
    return LB.row_mean_order(rows).where("place <= 20").select("sheet", "name", F.round("mean", 6).alias("mean"), "place")


@query("WITH o AS (SELECT l_orderkey AS task, sha256(array_to_string(list_sort(list(l_partkey || ':' || l_suppkey)), chr(10))) AS digest FROM lineitem GROUP BY l_orderkey) SELECT task, digest, true AS same_candidates, task % 4 <> 0 AS same_metrics FROM o")
def a35_order_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's items in three orders: one id set; a metric that differs in one order for every fourth."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("id"), "l_discount")
    runs = None
    for seed in (1, 2, 3):
        shuffled = items.withColumn("seed", F.xxhash64("id", F.lit(seed))).repartition("seed")
        run = LB.id_set_digest(shuffled, "task", F.col("id")).join(items.groupBy("task").agg(F.max("l_discount").alias("metric")), "task").withColumn("metric", F.col("metric") + F.when((F.col("task") % 4 == 0) & (F.lit(seed) == 3), 1e-6).otherwise(0.0))
        runs = run if runs is None else runs.unionByName(run)
    return LB.order_invariant(runs).join(runs.select("task", "digest").distinct(), "task").select("task", "digest", "same_candidates", "same_metrics")


_GRID = ["a b:1,0.5,0", "0.4,0.2,0.4", "x/y:0,0,2"]


@query("SELECT vec_id, label, round(w1 * embedding[1]::DOUBLE + w2 * embedding[2]::DOUBLE + w3 * embedding[3]::DOUBLE, 6) AS score FROM embeddings e, (VALUES ('a_b', 1.0, 0.5, 0.0), ('d0.4_s0.2_c0.4', 0.4, 0.2, 0.4), ('x_y', 0.0, 0.0, 2.0)) w(label, w1, w2, w3)".replace("e.label", "w.label").replace("SELECT vec_id, label,", "SELECT vec_id, w.label AS label,"))
def t39_weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three component scores under each weighting of a grid given as text."""
    grid = F.array(*(F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, w)).alias("w")) for label, *w in PA.weight_grid(_GRID)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("v"), F.explode(grid).alias("g"))
    return rows.select("vec_id", "g.label", F.round(A.dot(F.col("v"), F.col("g.w")), 6).alias("score"))


_INSTRUCTED = {"de": "Deutsch: ", "fr": "Texte: "}


@query("SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN CASE lang WHEN 'de' THEN 'Deutsch: ' WHEN 'fr' THEN 'Texte: ' ELSE '' END ELSE CASE WHEN lang = 'en' THEN 'passage: ' ELSE '' END END || text) AS prepared FROM documents")
def t30_prepared_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("doc_id") % 2 == 0, "query").otherwise("doc")
    prepared = PA.prepared_text(F.col("lang"), role, F.col("text"), "query_doc", {}, _INSTRUCTED, {"en": "passage: "})
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(prepared).alias("prepared"))


_RECORD = """CASE item_id % 5 WHEN 0 THEN to_json({'query_id': 'q' || item_id, 'query': text, 'positive': [text, ''], 'negative': {'text': 'n', 'doc': 'd'}}) WHEN 1 THEN to_json({'question': text, 'positives': 'one', 'negatives': [{'content': 'c'}, 'x']})
 WHEN 2 THEN to_json({'text': text, 'positive': [], 'relevant_docs': [text], 'hard_negatives': {'a': 'b'}}) WHEN 3 THEN to_json({'id': item_id, 'sentence': text, 'positive': 'p'}) ELSE to_json({'query': '', 'positive': 'p', 'negative': 'n'}) END"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, n = F.col("text"), F.col("item_id") % 5
    named = lambda **fields: F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))
    row = (
        F.when(n == 0, named(query_id=F.concat(F.lit("q"), F.col("item_id")), query=text, positive=F.array(text, F.lit("")), negative=F.struct(F.lit("n").alias("text"), F.lit("d").alias("doc"))))
        .when(n == 1, F.concat(F.lit('{"question":'), F.get_json_object(named(x=F.array(text)), "$.x").substr(F.lit(2), F.length(F.get_json_object(named(x=F.array(text)), "$.x")) - 2), F.lit(',"positives":"one","negatives":[{"content":"c"},"x"]}')))
        .when(n == 2, named(text=text, positive=F.array().cast("array<string>"), relevant_docs=F.array(text), hard_negatives=F.struct(F.lit("b").alias("a"))))
        .when(n == 3, named(id=F.col("item_id"), sentence=text, positive=F.lit("p")))
        .otherwise(named(query=F.lit(""), positive=F.lit("p"), negative=F.lit("n")))
    )
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq"), row.alias("row"))


@query("SELECT CASE item_id % 5 WHEN 0 THEN 'q' || item_id ELSE item_id::VARCHAR END AS qid, md5(text) AS query, CASE item_id % 5 WHEN 1 THEN 'one' ELSE md5(text) END AS positives, CASE item_id % 5 WHEN 0 THEN 'n|d' WHEN 1 THEN 'c|x' ELSE 'b' END AS negatives FROM benchmark WHERE item_id % 5 < 3")
def s12_t37_rerank_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of several forms; those without a query or a side are skipped, and counted apart."""
    used = LB.rerank_records(_records(spark, sf_dir))[0]
    shown = F.when(F.array_join("positives", "|") == "one", "one").otherwise(F.md5(F.array_join("positives", "|")))
    return used.select("qid", F.md5("query").alias("query"), shown.alias("positives"), F.array_join("negatives", "|").alias("negatives"))


@query("SELECT CASE WHEN item_id % 5 < 3 THEN 'used' ELSE 'skipped' END AS status, count(*)::BIGINT AS n FROM benchmark GROUP BY 1")
def s12_record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LB.rerank_records(_records(spark, sf_dir))[1]


@query("WITH l AS (SELECT doc_id AS did, doc_id % 40 AS qid, quality AS score FROM labels) SELECT qid, did, score > 0 AS positive FROM l")
def s10_judged_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select((F.col("doc_id") % 40).alias("qid"), F.col("doc_id").alias("did"), F.col("quality").alias("score"))
    good, bad = LB.judged_relevance(labels)
    return good.withColumn("positive", F.lit(True)).unionByName(bad.withColumn("positive", F.lit(False)))


_TASK = "WITH d AS (SELECT doc_id // 2 AS did, doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN 'code ' || doc_id ELSE text END AS text FROM documents)"


@query(_TASK + " SELECT 'c' || did AS did, md5(arg_max(text, seq)) AS text, CASE WHEN did % 4 = 0 THEN 'a' || did WHEN did % 4 = 1 THEN 'b' || did END AS anchor FROM d GROUP BY did")
def h10_t38_load_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two rows an id, the last of which counts; the same rows as queries with anchors in three forms."""
    docs, did = table(spark, sf_dir, "documents"), F.expr("doc_id div 2")
    code = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("code "), F.col("doc_id"))).otherwise("")
    corpus = docs.select(F.to_json(F.struct(F.concat(F.lit("c"), did).alias("doc_id"), F.when(code == "", F.col("text")).otherwise("").alias("text"), code.alias("code"))).alias("row"), F.col("doc_id").alias("seq"))
    flat = F.when(did % 4 == 0, F.concat(F.lit("a"), did)).otherwise("")
    meta = F.when(did % 4 == 1, F.concat(F.lit("{'k': 1, 'anchor_code_id': 'b"), did, F.lit("'}"))).otherwise("{}")
    queries = docs.select(F.to_json(F.struct(F.concat(F.lit("c"), did).alias("query_id"), F.lit("q").alias("query"), flat.alias("meta_anchor_code_id"), meta.alias("meta"))).alias("row"), F.col("doc_id").alias("seq"))
    qrels = docs.select(F.to_json(F.struct(F.lit("q").alias("query_id"), F.lit("d").alias("doc_id"), F.lit(1).alias("relevance"))).alias("row"), F.col("doc_id").alias("seq"))
    _, texts, _, excluded = LB.load_task(queries, corpus, qrels, True)
    return texts.join(excluded.select(F.col("qid").alias("did"), F.col("did").alias("anchor")), "did", "left").select("did", F.md5("text").alias("text"), "anchor")


@query("SELECT doc_id, to_json({'id': doc_id, 'lang': lang, 'score': round_even(n_chars / 7.0::DOUBLE, 4)})::VARCHAR AS json FROM documents")
def m15_rounded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.struct(F.col("doc_id").alias("id"), "lang", (F.col("n_chars") / 7.0).alias("score"))
    return table(spark, sf_dir, "documents").select("doc_id", PA.rounded_json(value, "score").alias("json"))


@query("SELECT item_id, 'Solve each grade school math problem. Give the reasoning, then end with ''#### <answer>''.' || chr(10) || chr(10) || 'Question: one' || chr(10) || 'Answer: 1 #### 1' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer: Let''s think step by step.' AS prompt FROM benchmark")
def x6_math_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = F.array(F.struct(F.lit("one").alias("question"), F.lit("1 #### 1").alias("answer")))
    return table(spark, sf_dir, "benchmark").select("item_id", PA.math_prompt(examples, F.col("text")).alias("prompt"))


@query("SELECT item_id, 'Here are some examples of how to solve similar problems:' || chr(10) || chr(10) || 'one' || chr(10) || chr(10) || 'Reasoning:' || chr(10) || '1 #### 2' || chr(10) || chr(10) || 'ANSWER: \\boxed{3}' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Please reason step by step, and put your final answer within \\boxed{}.' AS prompt FROM benchmark")
def x6_boxed_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = F.array(F.struct(F.lit("one").alias("question"), F.lit("1 #### 2 #### 3").alias("answer")))
    return table(spark, sf_dir, "benchmark").select("item_id", PA.math_prompt(examples, F.col("text"), "boxed").alias("prompt"))


@query("WITH b AS (SELECT page_id % 4 AS step, page_id AS pos, 'http://h/' || page_id % 60 || repeat('/', page_id % 2) AS url FROM pages) SELECT step, pos, url FROM (SELECT *, row_number() OVER (PARTITION BY rtrim(url, '/') ORDER BY step, pos) AS r FROM b) WHERE r = 1")
def d6_d7_research_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("step"), F.col("page_id").alias("pos"), F.expr("concat('http://h/', page_id % 60, repeat('/', int(page_id % 2)))").alias("url"))
    meta = batches.groupBy("step").agg(F.count("*").alias("raw_results"), F.max("pos").alias("elapsed_ms"))
    return LB.research_union(batches, meta)[0].select("step", "pos", "url")


@query("SELECT count(*)::BIGINT AS raw_results, max(page_id) AS elapsed_ms, count(DISTINCT page_id % 4)::BIGINT AS research_steps FROM pages")
def d7_research_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("step"), F.col("page_id").alias("pos"), "url")
    return LB.research_union(batches, batches.groupBy("step").agg(F.count("*").alias("raw_results"), F.max("pos").alias("elapsed_ms")))[1]


@query(
    f"WITH j AS (SELECT DISTINCT doc_id FROM labels), o AS (SELECT doc_id, row_number() OVER (ORDER BY {_fraction('corpus', 'doc_id')}, doc_id) AS r FROM documents ANTI JOIN j USING (doc_id)) SELECT doc_id AS did FROM documents SEMI JOIN j USING (doc_id) UNION ALL SELECT doc_id FROM o WHERE r <= greatest(0, 500 - (SELECT count(*) FROM documents SEMI JOIN j USING (doc_id)))"
)
def h17_sampled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents and others, 500 in all."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("did"))
    return LB.sampled_corpus(ids, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("did")), 500, "corpus")


_GENERATED = "CASE item_id % 5 WHEN 0 THEN 'think</think>```python' || chr(10) || 'import os' || chr(10) || 'def f(x):' || chr(10) || '  a = 1' || chr(10) || chr(10) || '  return ' || item_id || chr(10) || 'def g():' || chr(10) || '  pass' || chr(10) || '```' WHEN 1 THEN 'return ' || item_id || chr(10) || 'print(1)' WHEN 2 THEN '    return ' || item_id || chr(10) || '# end' WHEN 3 THEN 'def h():' || chr(10) || '    return 1  ' ELSE '```one' END"


@query(
    "SELECT item_id, CASE item_id % 5 WHEN 0 THEN '    a = 1' || chr(10) || chr(10) || '    return ' || item_id || chr(10) || 'import os' || chr(10) || 'def g():' || chr(10) || '  pass' WHEN 1 THEN '    return ' || item_id WHEN 2 THEN '    return ' || item_id WHEN 3 THEN 'def h():' || chr(10) || '    return 1' ELSE '    ```one' END || chr(10) AS code FROM benchmark"
)
def t36_clean_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thoughts and fences around a function, plain bodies with endings, other functions, a lone fence."""
    return table(spark, sf_dir, "benchmark").select("item_id", CO.cleaned(F.expr(_GENERATED.replace("chr(10)", "'\\n'")), F.lit("f")).alias("code"))


@query(
    _ROWS
    + f""", e AS (SELECT key, neg, CASE WHEN {_fraction('prep', 'key')} < 0.2 THEN 'eval' ELSE 'train' END AS split FROM rows WHERE len(pos) > 0 AND len(neg) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY key) AS place FROM e)
SELECT split, count(DISTINCT key)::BIGINT AS rows, 2 * count(DISTINCT key)::BIGINT AS negatives FROM r WHERE place <= CASE split WHEN 'train' THEN 300 ELSE 50 END GROUP BY split"""
)
def h6_prepared_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a positive and two negatives, split, cut, and two negatives chosen for each: counts by split."""
    rows = _rows(spark, sf_dir)
    items = rows.select("key", F.posexplode("neg").alias("idx", "margin"))
    chosen, _ = LB.prepared_splits(rows, items, [("no_positive", F.size("pos") == 0), ("few_negatives", F.size("neg") < 2)], 0.2, "prep", [F.col("key")], {"hard": 1, "middle": 1, "easy": 1}, 2, 300, 50)
    return chosen.groupBy("split").agg(F.countDistinct("key").alias("rows"), F.count("*").alias("negatives"))
