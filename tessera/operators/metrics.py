"""Ranking metrics: cut-off metrics of runs, and expected metrics under ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _gain(rank) -> F.Column:
    return 1.0 / F.log2(rank + 1.0)


def _ideal(n, k: int) -> F.Column:
    """The best possible discounted gain of ``n`` relevant documents at ``k``."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n.cast("int"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda a, r: a + _gain(r))


def run_metrics(run: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """A row per query of ``queries`` (qid): nDCG, MAP, MRR, recall, precision and hit rate at ``k``, and whether its run is missing.

    ``run`` (qid, did, rank), ``relevant`` (qid, did).  MAP divides by the lesser of the
    relevant documents and ``k``; queries with no relevant document score 0.
    """
    good = relevant.select("qid", "did").distinct()
    hits = run.where(F.col("rank") <= k).join(good.withColumn("hit", F.lit(1)), ["qid", "did"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return judged_metrics(hits, good.groupBy("qid").agg(F.count("*").alias("n")), queries, k)


def judged_metrics(judged: DataFrame, sizes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The same from a run whose rows are judged, ``judged`` (qid, rank, hit), and the number of relevant documents of each query, ``sizes`` (qid, n)."""
    hits = judged.where(F.col("rank") <= k)
    so_far = F.sum("hit").over(Window.partitionBy("qid").orderBy("rank"))
    by_query = hits.withColumn("found", so_far).groupBy("qid").agg(
        F.sum(F.when(F.col("hit") == 1, _gain(F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("hit") == 1, F.col("found") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.max(F.when(F.col("hit") == 1, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"),
        F.sum("hit").alias("hits"),
    )
    all_rows = queries.select("qid").join(by_query, "qid", "left").join(sizes, "qid", "left").withColumn("missing", F.col("hits").isNull()).na.fill(0)
    some = F.col("n") > 0
    return all_rows.select(
        "qid",
        F.when(some, F.col("dcg") / _ideal(F.col("n"), k)).otherwise(0.0).alias("ndcg"),
        F.when(some, F.col("precisions") / F.least("n", F.lit(k))).otherwise(0.0).alias("map"),
        F.when(some, F.col("mrr")).otherwise(0.0).alias("mrr"),
        F.when(some, F.col("hits") / F.col("n")).otherwise(0.0).alias("recall"),
        (F.col("hits") / F.lit(k)).alias("precision"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        "missing",
    )


METRICS = ("ndcg", "map", "mrr", "recall", "precision", "hit_rate")


def mean_metrics(by_query: DataFrame, *keys: str) -> DataFrame:
    means = [F.avg(m).alias(m) for m in METRICS]
    return by_query.groupBy(*keys).agg(F.count("*").alias("queries"), F.sum(F.col("missing").cast("long")).alias("missing_queries"), *means)


def weighted_average(by_task: DataFrame, metric: str) -> DataFrame:
    return by_task.agg(F.coalesce(F.try_divide(F.sum(F.col(metric) * F.col("queries")), F.sum("queries")), F.lit(0.0)).alias(metric))


def tie_aware_metrics(scored: DataFrame, k: int = 10) -> DataFrame:
    """Expected AP, reciprocal rank and graded nDCG of (qid, label, score), over all orders of equal scores.

    Blocks of equal scores are grouped first, so a row per block is left before anything is
    expanded by rank.
    """
    block = scored.groupBy("qid", "score").agg(
        F.count("*").alias("size"), F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("hits"), F.avg(F.pow(F.lit(2.0), F.col("label")) - 1).alias("gain")
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    block = block.withColumns({"seen": F.coalesce(F.sum("size").over(order), F.lit(0)), "before": F.coalesce(F.sum("hits").over(order), F.lit(0))})
    size, hits = F.col("size"), F.col("hits")
    offsets = F.sequence(F.lit(1).cast("long"), size)
    ap = F.aggregate(
        offsets,
        F.lit(0.0),
        lambda a, o: a + (hits / size) * (F.col("before") + 1 + F.when(size > 1, (o - 1) * (hits - 1) / F.greatest(size - 1, F.lit(1))).otherwise(0.0)) / (F.col("seen") + o),
    )
    # The chance that the block's first hit stands at an offset, by products of ratios.
    miss = F.aggregate(
        offsets,
        F.struct(F.lit(1.0).alias("none"), F.lit(0.0).alias("sum")),
        lambda s, o: F.struct(
            (s["none"] * F.greatest(F.lit(0.0), 1 - hits / (size - o + 1))).alias("none"),
            (s["sum"] + s["none"] * F.least(F.lit(1.0), hits / (size - o + 1)) / (F.col("seen") + o)).alias("sum"),
        ),
        lambda s: s["sum"],
    )
    last = F.least(F.col("seen") + size, F.lit(k))
    dcg = F.when(F.col("seen") < k, F.aggregate(F.sequence(F.col("seen") + 1, last), F.lit(0.0), lambda a, r: a + F.col("gain") * _gain(r))).otherwise(0.0)
    by_query = block.groupBy("qid").agg(
        F.sum(F.when(hits > 0, ap).otherwise(0.0)).alias("precisions"),
        F.sum("hits").alias("positives"),
        F.max(F.when((hits > 0) & (F.col("before") == 0), miss).otherwise(0.0)).alias("mrr"),
        F.sum(dcg).alias("dcg"),
    )
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("label")))).where(F.col("r") <= k)
    ideal = top.groupBy("qid").agg(F.sum((F.pow(F.lit(2.0), F.col("label")) - 1) * _gain(F.col("r"))).alias("ideal"))
    return by_query.join(ideal, "qid").select(
        "qid",
        F.when(F.col("positives") > 0, F.col("precisions") / F.col("positives")).otherwise(0.0).alias("map"),
        "mrr",
        F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"),
    )


def top_margin(scored: DataFrame) -> DataFrame:
    """The best score less the second best of each query; infinity for a single one."""
    r = scored.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))).where("r <= 2")
    return r.groupBy("qid").agg(F.when(F.count("*") < 2, F.lit(float("inf"))).otherwise(F.max("score") - F.min("score")).alias("margin"))


def least_positive_margin(scored: DataFrame) -> DataFrame:
    """The least positive less the greatest negative score of each query; 0 where either is missing."""
    low, high = F.min(F.when(F.col("label") > 0, F.col("score"))), F.max(F.when(F.col("label") <= 0, F.col("score")))
    return scored.groupBy("qid").agg(F.coalesce(low - high, F.lit(0.0)).alias("margin"))
