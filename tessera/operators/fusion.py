"""Rank fusion and score blending over runs (qid, did, score, rank)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.retrieval import top_k

# The weights of nine score surfaces (dense, sparse, multi-vector).
SURFACES = {
    "model_card": (0.4, 0.2, 0.4),
    "training_default": (1.0, 0.3, 1.0),
    "dense_heavy": (0.6, 0.2, 0.2),
    "sparse_heavy": (0.25, 0.5, 0.25),
    "colbert_heavy": (0.25, 0.15, 0.6),
    "dense_sparse": (0.7, 0.3, 0.0),
    "dense_colbert": (0.5, 0.0, 0.5),
    "sparse_colbert": (0.0, 0.33, 0.67),
    "colbert_only": (0.0, 0.0, 1.0),
}


def reciprocal_rank_fusion(runs: list[DataFrame], weights: list[float], k: int = 60, limit: int = 10) -> DataFrame:
    """Weighted sums of ``1 / (k + rank)`` over ranked runs."""
    parts = [run.select("qid", "did", (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for run, w in zip(runs, weights)]
    return top_k(reduce(DataFrame.unionByName, parts).groupBy("qid", "did").agg(F.sum("part").alias("score")), limit, 12)


def rank_of(score: Column, by: str = "qid", tie: str = "did") -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(score.desc(), tie))


def midrank_reciprocal(score: Column, k: float = 60.0, by: str = "qid") -> Column:
    """``1 / (k + rank)`` where equal scores share their middle rank."""
    group = Window.partitionBy(by)
    rank = F.rank().over(group.orderBy(score.desc()))
    same = F.count("*").over(Window.partitionBy(by, score))
    return 1.0 / (k + rank + (same - 1) / 2.0)


def zscore(score: Column, by: str = "qid", least: float = 1e-12) -> Column:
    """Standardised in its group by the population deviation; 0 where that is below ``least``."""
    group = Window.partitionBy(by)
    deviation = F.stddev_pop(score).over(group)
    return F.when(deviation < least, 0.0).otherwise((score - F.avg(score).over(group)) / deviation)


def minmax(score: Column, by: str = "qid") -> Column:
    """Scaled to 0 to 1 in its group; 0 where all are equal."""
    group = Window.partitionBy(by)
    low, high = F.min(score).over(group), F.max(score).over(group)
    return F.when(high == low, 0.0).otherwise((score - low) / (high - low))


def blended(first: Column, second: Column, alpha: Column, mode: Column | str) -> Column:
    """``alpha`` x second + (1 - alpha) x first under a mode: one of the two alone, or both scaled, standardised or ranked."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    mixed = lambda f: alpha * f(second) + (1 - alpha) * f(first)
    return (
        F.when(mode == "reranker", second)
        .when(mode == "first_stage", first)
        .when(mode == "minmax", mixed(minmax))
        .when(mode == "zscore", mixed(lambda x: zscore(x, least=1e-300)))
        .when(mode == "rrf", mixed(lambda x: 1.0 / rank_of(x)))
    )


def fused(dense: Column, sparse: Column, multi: Column, weights: tuple[float, float, float]) -> Column:
    return weights[0] * dense + weights[1] * sparse + weights[2] * multi


def gate(base: Column, alternate: Column, margin: Column, threshold: float) -> Column:
    """The alternate score for queries whose margin is at most the threshold."""
    return F.when(margin <= threshold, alternate).otherwise(base)
