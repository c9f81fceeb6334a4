"""Queries of score statistics, margins, strata, splits and gates.

Orders stand for scored training rows: line items with return flag N are positives, the
others negatives, with two score surfaces (price and quantity).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import sampling as S
from tessera.operators import stats as ST
from tessera.plans.registry import listed, query, table

_ROWS = """
WITH items AS (SELECT l_orderkey AS key, (l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, l_extendedprice / 20000 AS s1, l_quantity / 10 AS s2, l_returnflag = 'N' AS good FROM lineitem),
rows AS (SELECT key, coalesce(list(s1 ORDER BY i) FILTER (good), []) AS pos, coalesce(list(s1 ORDER BY i) FILTER (NOT good), []) AS neg, coalesce(list(s2 ORDER BY i) FILTER (good), []) AS pos2, coalesce(list(s2 ORDER BY i) FILTER (NOT good), []) AS neg2 FROM items GROUP BY key)
"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("i"), (F.col("l_extendedprice") / 20000).alias("s1"), (F.col("l_quantity") / 10).alias("s2"), (F.col("l_returnflag") == "N").alias("good"))
    # A row's items are few and of one order; arrays are sorted by line number, then by the rest of the key.
    side = lambda c, good: F.transform(F.array_sort(F.collect_list(F.when(F.col("good") == good, F.struct("i", c)))), lambda x: x[c])
    return items.groupBy("key").agg(side("s1", True).alias("pos"), side("s1", False).alias("neg"), side("s2", True).alias("pos2"), side("s2", False).alias("neg2"))


_BOTH = "len(pos) > 0 AND len(neg) > 0"
_QUALITY = f"(SELECT key, pos, neg, pos2, neg2, list_max(pos) - list_max(neg) AS best_margin, list_min(pos) - list_max(neg) AS all_margin, list_avg(pos) - list_avg(neg) AS mean_margin FROM rows WHERE {_BOTH})"


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return rows.withColumn("q", A.row_quality(F.col("pos"), F.col("neg"))).where("q is not null").select("key", "pos", "neg", "pos2", "neg2", "q.*")


@query(_ROWS + f"SELECT key, round(best_margin, 8) AS best_margin, round(all_margin, 8) AS all_margin, round(mean_margin, 8) AS mean_margin FROM {_QUALITY}")
def a21_row_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).select("key", *(F.round(c, 8).alias(c) for c in ("best_margin", "all_margin", "mean_margin")))


_BIN = "CASE WHEN {m} < 0 THEN 'negative' WHEN {m} < 0.5 THEN '0_to_0.5' WHEN {m} < 1 THEN '0.5_to_1' WHEN {m} < 2 THEN '1_to_2' WHEN {m} < 4 THEN '2_to_4' ELSE '4_plus' END"


@query(
    _ROWS
    + f"SELECT {_BIN.format(m='round(best_margin, 9)')} AS bin, count(*)::BIGINT AS n, round(avg(best_margin), 6) AS mean, round(min(best_margin), 6) AS least, round(max(best_margin), 6) AS most, round(quantile_cont(best_margin, 0.05), 6) AS p05, round(quantile_cont(best_margin, 0.25), 6) AS p25, round(quantile_cont(best_margin, 0.5), 6) AS p50, round(quantile_cont(best_margin, 0.75), 6) AS p75, round(quantile_cont(best_margin, 0.95), 6) AS p95 FROM {_QUALITY} GROUP BY 1"
)
def a17_a18_m4_margin_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _quality(spark, sf_dir).withColumn("bin", A.margin_bin(F.round("best_margin", 9)))
    out = q.groupBy("bin").agg(*ST.numeric_stats(F.col("best_margin")))
    return out.select("bin", "n", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


@query("SELECT event_type, round(corr(value, user_id::DOUBLE), 6) AS r, round(avg(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END), 6) AS mean_with_nulls, round(avg(CASE WHEN event_id % 3 <> 0 THEN value END), 6) AS mean_defined, round(list_sort(list(value))[round_even((count(*) - 1) * 0.95::DOUBLE, 0)::INT + 1], 6) AS p95 FROM events GROUP BY event_type")
def a8_a19_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(ST.pearson(F.col("value"), F.col("user_id").cast("double")), 6).alias("r"), F.round(ST.mean_with_nulls(value), 6).alias("mean_with_nulls"), F.round(F.avg(value), 6).alias("mean_defined"), F.round(ST.nearest_rank(F.col("value"), 0.95), 6).alias("p95")
    )


_MM = "CASE WHEN list_max({x}) = list_min({x}) THEN 0.5 ELSE (v - list_min({x})) / (list_max({x}) - list_min({x})) END"


@query(
    _ROWS
    + f", n AS (SELECT key, list_concat(pos, neg) AS a, list_concat(pos2, neg2) AS b FROM rows), m AS (SELECT key, list_transform(a, lambda v: {_MM.format(x='a')}) AS a, list_transform(b, lambda v: {_MM.format(x='b')}) AS b FROM n) SELECT key, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: (0.7::DOUBLE * a[i] + 0.3::DOUBLE * b[i]) * i)), 6) AS blend, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] / 3::DOUBLE + b[i] * 2 / 3::DOUBLE) * i)), 6) AS averaged FROM m"
)
def m5_m7_blended_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select("key", F.concat("pos", "neg").alias("a"), F.concat("pos2", "neg2").alias("b"))
    both = rows.select("key", A.blend(F.col("a"), F.col("b"), 0.7).alias("x"), A.weighted_minmax([(F.col("a"), 1.0), (F.col("b"), 2.0), (F.col("a"), 0.0)]).alias("y"))
    checked = lambda c: F.round(A.total(F.transform(c, lambda v, i: v * (i + 1))), 6)
    return both.select("key", checked(F.col("x")).alias("blend"), checked(F.col("y")).alias("averaged"))


@query(_ROWS + f"SELECT key, round(list_sum(list_transform(range(1, len(neg) + 1), lambda i: i * CASE WHEN list_max(pos) - neg[i] <= 0.1 OR list_max(pos2) - neg2[i] <= 0.1 THEN 0.8 ELSE 0 END)), 6)::DOUBLE AS kept FROM rows WHERE {_BOTH}")
def m8_anti_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _quality(spark, sf_dir)
    kept = A.anti_regression([F.col("neg"), F.col("neg2")], 0.2, 0.1, [F.array_max("pos"), F.array_max("pos2")])
    return q.select("key", F.round(A.total(F.transform(kept, lambda v, i: v * (i + 1))), 6).alias("kept"))


@query(
    _ROWS
    + f", h AS (SELECT key, list_position(pos, list_max(pos)) - 1 AS best, list_max(pos) AS top, list_sort(list_transform(range(len(neg)), lambda i: (-neg[i + 1], i)))[1:3] AS o FROM rows WHERE {_BOTH}) SELECT key, best::INT AS best, array_to_string(list_transform(o, lambda x: x[2]), ',') AS hardest, round(list_sum(list_transform(o, lambda x: tanh(top + x[1]))), 6) AS margins FROM h"
)
def m3_m9_w19_hardest_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _quality(spark, sf_dir).withColumn("o", A.hardest(F.col("neg"), 3))
    margins = A.total(F.transform("o", lambda i: A.margin(F.array_max("pos") - F.get("neg", i), "tanh")))
    return q.select("key", A.best_index(F.col("pos")).alias("best"), F.array_join(F.col("o").cast("array<string>"), ",").alias("hardest"), F.round(margins, 6).alias("margins"))


def _fraction(seed: str, x: str) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || {x}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616::DOUBLE)"


@query(f"SELECT doc_id, round({_fraction('s', 'doc_id')}, 12) AS f FROM documents")
def l3_stable_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(S.stable_fraction(F.col("doc_id"), "s"), 12).alias("f"))


@query(f"SELECT doc_id, split, place FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY n_chars DESC, doc_id) AS place FROM (SELECT doc_id, n_chars, CASE WHEN {_fraction('split', 'doc_id')} < 0.15 THEN 'eval' ELSE 'train' END AS split FROM documents)) WHERE place <= CASE split WHEN 'train' THEN 300 ELSE 50 END")
def l4_split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.split_rows(table(spark, sf_dir, "documents"), "doc_id", 0.15, "split", [F.desc("n_chars"), F.col("doc_id")], 300, 50)
    return out.select("doc_id", "split", F.col("place").cast("long").alias("place"))


@query(f"SELECT doc_id, ((row_number() OVER (ORDER BY {_fraction('fold', 'doc_id')}, doc_id) - 1) % 5)::BIGINT AS fold FROM labels")
def l10_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash order, dealt round-robin; the rank comes from counts by range, so no single task sorts all rows."""
    f = table(spark, sf_dir, "labels").select("doc_id", S.stable_fraction(F.col("doc_id"), "fold").alias("f")).withColumn("part", F.floor(F.col("f") * 256))
    from pyspark.sql.window import Window

    before = f.groupBy("part").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("f", "doc_id"))
    return f.withColumn("r", place).join(before, "part").select("doc_id", ((F.col("first") + F.col("r") - 1) % 5).cast("long").alias("fold"))


_M = "((n_chars * 7 + doc_id) % 700) / 100::DOUBLE - 1"
_STRATUM = "CASE WHEN m < 1 THEN 'hard' WHEN m < 4 THEN 'middle' ELSE 'easy' END"


@query(
    f"""
WITH r AS (SELECT source AS key, doc_id AS idx, {_M} AS m FROM documents), s AS (SELECT *, {_STRATUM} AS stratum, {_fraction('neg', "key || ':' || idx")} AS h FROM r),
a AS (SELECT *, row_number() OVER (PARTITION BY key, stratum ORDER BY CASE stratum WHEN 'hard' THEN m WHEN 'middle' THEN abs(m - 2.5::DOUBLE) ELSE h END, CASE stratum WHEN 'easy' THEN m ELSE h END) AS r FROM s),
b AS (SELECT *, (r > CASE stratum WHEN 'hard' THEN 3 WHEN 'middle' THEN 3 ELSE 2 END)::INT AS filler FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY filler, CASE WHEN filler = 1 THEN h ELSE 0 END, CASE stratum WHEN 'hard' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END, r) AS place FROM b)
SELECT key, idx, stratum, filler FROM c WHERE place <= 10"""
)
def l5_choose_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("idx"), (((F.col("n_chars") * 7 + F.col("doc_id")) % 700) / 100.0 - 1).alias("margin"))
    return S.choose_negatives(items, {"hard": 3, "middle": 3, "easy": 2}, 10, "neg")


@query("SELECT doc_id, CASE WHEN t <= 0.05 AND h <= 0.05 THEN 'agreement_hard' WHEN h <= 0.05 AND t >= 0.1 THEN 'hybrid_false_positive' WHEN t <= 0.05 THEN 'target_hard' WHEN t <= 0.5 THEN 'middle' ELSE 'easy' END AS stratum FROM (SELECT doc_id, (doc_id % 17) / 16::DOUBLE AS t, (doc_id % 5) / 20::DOUBLE AS h FROM documents)")
def l6_classify_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, h = (F.col("doc_id") % 17) / 16, (F.col("doc_id") % 5) / 20
    return table(spark, sf_dir, "documents").select("doc_id", S.classify_negative(t, h, 0.05, 0.05, 0.5, 0.1).alias("stratum"))


_ORDER = ["negative", "0_to_0.5", "0.5_to_1", "1_to_2", "2_to_4", "4_plus"]


@query(f"WITH r AS (SELECT doc_id, {_M} AS m FROM documents), b AS (SELECT doc_id, m, {_BIN.format(m='m')} AS bin FROM r), c AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY m, doc_id) AS r FROM b) SELECT doc_id, bin FROM (SELECT *, row_number() OVER (ORDER BY r, list_position([{listed(_ORDER)}], bin)) AS k FROM c) WHERE k <= 100")
def l8_balanced_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ((F.col("n_chars") * 7 + F.col("doc_id")) % 700) / 100.0 - 1
    rows = table(spark, sf_dir, "documents").select("doc_id", m.alias("m"), A.margin_bin(m).alias("bin"))
    return S.balanced(rows, _ORDER, [F.col("m"), F.col("doc_id")], 100).select("doc_id", "bin")


@query(
    """
WITH s AS (SELECT source AS label, count(*)::DOUBLE AS score FROM documents GROUP BY source), p AS (SELECT *, score / sum(score) OVER () * (100 - count(*) OVER ()) AS share FROM s), w AS (SELECT *, floor(share) AS whole FROM p),
r AS (SELECT *, (100 - count(*) OVER ()) - sum(whole) OVER () AS spare, row_number() OVER (ORDER BY share - whole DESC, score DESC, label DESC) AS k FROM w) SELECT label, (1 + whole + (k <= spare)::INT)::BIGINT AS n FROM r"""
)
def l9_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.allocate(table(spark, sf_dir, "documents").groupBy(F.col("source").alias("label")).agg(F.count("*").cast("double").alias("score")), 100)


_DELTAS = "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS split, o_orderpriority AS label, o_custkey AS q, ((o_orderkey * 31) % 201 - 80) / 1000::DOUBLE AS delta FROM orders"


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.when(key % 3 == 0, "a").when(key % 3 == 1, "b").otherwise("c").alias("split"), F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("q"), ((key * 31 % 201 - 80) / 1000.0).alias("delta"))


@query(f"WITH d AS ({_DELTAS}), m AS (SELECT split, label, avg(delta) AS delta FROM d GROUP BY ALL) SELECT label, round(avg(delta), 6) AS mean, round(min(delta), 6) AS least, round(avg((delta >= 0.02)::INT), 6) AS pass_fraction, bool_and(delta >= 0.02) AS passes FROM m GROUP BY label")
def a24_a25_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_split = _deltas(spark, sf_dir).groupBy("split", "label").agg(F.avg("delta").alias("delta"))
    return ST.gate(by_split, 0.02).select("label", F.round("mean", 6).alias("mean"), F.round("least", 6).alias("least"), F.round("pass_fraction", 6).alias("pass_fraction"), "passes")


@query(f"WITH d AS ({_DELTAS}) SELECT label, round((1 - avg((delta >= 0.02)::INT)) + avg((delta < 0)::INT) + greatest(0, 0.02::DOUBLE - avg(delta)) / 0.02::DOUBLE, 6) AS risk FROM d GROUP BY label")
def m11_surface_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("delta")
    s = _deltas(spark, sf_dir).groupBy("label").agg(F.avg((d >= 0.02).cast("double")).alias("p"), F.avg((d < 0).cast("double")).alias("r"), F.avg(d).alias("m"))
    return s.select("label", F.round(ST.surface_risk(F.col("p"), F.col("r"), F.col("m"), 0.02), 6).alias("risk"))


@query(f"WITH d AS ({_DELTAS}), m AS (SELECT label, q, avg(delta) AS delta FROM d GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(delta, 9), q) AS lo, row_number() OVER (PARTITION BY label ORDER BY round(delta, 9) DESC, q) AS hi FROM m) SELECT label, q, round(delta, 6) AS delta, CASE WHEN lo <= 5 THEN 'worst' ELSE 'best' END AS side FROM r WHERE lo <= 5 OR hi <= 5")
def w20_worst_and_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    m = _deltas(spark, sf_dir).groupBy("label", "q").agg(F.avg("delta").alias("delta"))
    near = F.round("delta", 9)
    r = m.withColumns({"lo": F.row_number().over(Window.partitionBy("label").orderBy(near, "q")), "hi": F.row_number().over(Window.partitionBy("label").orderBy(near.desc(), "q"))})
    return r.where("lo <= 5 or hi <= 5").select("label", "q", F.round("delta", 6).alias("delta"), F.when(F.col("lo") <= 5, "worst").otherwise("best").alias("side"))


@query(f"WITH d AS ({_DELTAS}) SELECT coalesce(split, 'all') AS split, coalesce(label, 'all') AS label, count(*)::BIGINT AS n, round(avg(delta), 6) AS mean, count(*) FILTER (delta >= 0.02)::BIGINT AS passes FROM d GROUP BY ROLLUP (split, label)")
def a22_counters_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _deltas(spark, sf_dir).rollup("split", "label").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean"), F.count_if(F.col("delta") >= 0.02).alias("passes"))
    return out.withColumns({"split": F.coalesce("split", F.lit("all")), "label": F.coalesce("label", F.lit("all"))})


@query("SELECT q AS doc_id, ('0' || '') || lpad(q::VARCHAR, 20, '0') AS key FROM (SELECT doc_id AS q FROM documents) WHERE (q // 3) % 7 = 0")
def f18_t32_stride_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh group of three ids, with the sort key of numeric ids."""
    return table(spark, sf_dir, "documents").where("(doc_id div 3) % 7 = 0").select("doc_id", F.concat(F.lit("0"), F.lpad(F.col("doc_id").cast("string"), 20, "0")).alias("key"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unjudged' ELSE 'judged' END AS kind, row_number() OVER (PARTITION BY source ORDER BY (l.doc_id IS NULL)::INT, n_chars DESC, d.doc_id) AS place FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0) l ON l.doc_id = d.doc_id")
def j15_judged_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    judged = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit(True).alias("judged"))
    rows = table(spark, sf_dir, "documents").join(judged, "doc_id", "left").withColumn("kind", F.when(F.col("judged"), "judged").otherwise("unjudged"))
    order = Window.partitionBy("source").orderBy(F.col("judged").isNull().cast("int"), F.desc("n_chars"), "doc_id")
    return rows.select("doc_id", "kind", F.row_number().over(order).cast("long").alias("place"))
