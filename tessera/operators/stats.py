"""Summaries of scores, margins, deltas and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numeric_stats(value: Column) -> list[Column]:
    """Count, mean, extremes and exact interpolated percentiles."""
    out = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most")]
    return out + [F.percentile(value, p).alias(f"p{round(100 * p):02d}") for p in (0.05, 0.25, 0.5, 0.75, 0.95)]


def nearest_rank(value: Column, p: float) -> Column:
    """The value at the half-even rounded place ``(n - 1) p`` of all sorted values; an array of a group's values is made, for small groups."""
    ordered = F.array_sort(F.collect_list(value))
    return F.element_at(ordered, (F.bround((F.size(ordered) - 1) * p) + 1).cast("int"))


def mean_with_nulls(value: Column) -> Column:
    """The mean where a missing value counts 0."""
    return F.coalesce(F.avg(F.coalesce(value, F.lit(0.0))), F.lit(0.0))


def pearson(x: Column, y: Column) -> Column:
    """The correlation; null for fewer than two rows or no variance."""
    r = F.corr(x, y)
    return F.when(~F.isnan(r) & (F.count(x) >= 2), r)


def gate(deltas: DataFrame, required: float) -> DataFrame:
    """Labels (split, label, delta) that every split has, with their means and whether each split passes; the best first."""
    splits = deltas.select("split").distinct().count()
    by_label = deltas.groupBy("label").agg(F.countDistinct("split").alias("splits"), F.avg("delta").alias("mean"), F.min("delta").alias("least"), F.avg((F.col("delta") >= required).cast("double")).alias("pass_fraction"), F.bool_and(F.col("delta") >= required).alias("passes"))
    return by_label.where(F.col("splits") == splits)


def surface_risk(pass_fraction: Column, regression_fraction: Column, mean_delta: Column, required: float) -> Column:
    return (1.0 - pass_fraction) + regression_fraction + F.greatest(F.lit(0.0), required - mean_delta) / max(required, 1e-12)
