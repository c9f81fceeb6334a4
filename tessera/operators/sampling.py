"""Deterministic splits, strata and quotas of scored training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.arrays import margin_bin
from tessera.operators._lineage import cut


def stable_fraction(value: Column, seed: str) -> Column:
    """0 to 1 from the first eight bytes of the SHA-256 of ``seed:value``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(18446744073709551616.0)


def ranked(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``place``, from 1, in each of few large groups.

    Rows are dealt by ranges of group and order, and numbered inside a range; the counts of
    the ranges before it are added.  No task sorts a whole group.
    """
    dealt = cut(rows.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n")).select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(firsts, [group, "_part"]).withColumn("place", (F.col("_first") + F.col("_own")).cast("int")).drop("_part", "_own", "_first")


def split_rows(rows: DataFrame, key: str, held_out: float, seed: str, order: list[Column], most_train: int = 0, most_eval: int = 0) -> DataFrame:
    """``rows`` with ``split`` (train or eval) by the key's fraction, ranked in it by ``order`` and cut at the caps (0: none)."""
    side = F.when(stable_fraction(F.col(key), seed) < held_out, "eval").otherwise("train")
    cap = F.when(F.col("split") == "train", most_train or (1 << 31) - 1).otherwise(most_eval or (1 << 31) - 1)
    return ranked(rows.withColumn("split", side), "split", order).where(F.col("place") <= cap)


def stratum(margin: Column) -> Column:
    label = margin_bin(margin)
    return F.when(label.isin("negative", "0_to_0.5", "0.5_to_1"), "hard").when(label.isin("1_to_2", "2_to_4"), "middle").otherwise("easy")


def choose_negatives(items: DataFrame, quotas: dict[str, int], total: int, seed: str) -> DataFrame:
    """Per row key, the quota of each stratum, then more of the rest up to ``total``; ``items`` (key, idx, margin).

    Hard ones come by margin, middle ones by closeness to 2.5, easy ones and fillers by
    a stable hash.
    """
    hashed = stable_fraction(F.concat_ws(":", "key", "idx"), seed)
    rows = items.withColumn("stratum", stratum(F.col("margin"))).withColumn("h", hashed)
    first = F.when(F.col("stratum") == "hard", F.col("margin")).when(F.col("stratum") == "middle", F.abs(F.col("margin") - 2.5)).otherwise(F.col("h"))
    second = F.when(F.col("stratum") == "easy", F.col("margin")).otherwise(F.col("h"))
    r = F.row_number().over(Window.partitionBy("key", "stratum").orderBy(first, second))
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col("stratum") == name, n).otherwise(quota)
    ranked = rows.withColumn("r", r).withColumn("filler", (F.col("r") > quota).cast("int"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("filler", F.when(F.col("filler") == 1, F.col("h")).otherwise(0.0), F.when(F.col("stratum") == "hard", 0).when(F.col("stratum") == "middle", 1).otherwise(2), "r"))
    return ranked.withColumn("place", place).where(F.col("place") <= total).select("key", "idx", "stratum", "filler")


def classify_negative(target: Column, hybrid: Column, target_hard: float, hybrid_hard: float, middle: float, separation: float) -> Column:
    return (
        F.when((target <= target_hard) & (hybrid <= hybrid_hard), "agreement_hard")
        .when((hybrid <= hybrid_hard) & (target >= separation), "hybrid_false_positive")
        .when(target <= target_hard, "target_hard")
        .when(target <= middle, "middle")
        .otherwise("easy")
    )


def balanced(rows: DataFrame, bin_order: list[str], order: list[Column], most: int) -> DataFrame:
    """Round-robin over the bins of column ``bin`` until ``most`` rows."""
    at = F.array_position(F.array(*map(F.lit, bin_order)), F.col("bin"))
    return ranked(rows, "bin", order).withColumnRenamed("place", "r").orderBy("r", at).limit(most)


def allocate(scores: DataFrame, total: int) -> DataFrame:
    """Counts by largest remainders, at least 1 for each positive score; ``scores`` (label, score)."""
    every = Window.partitionBy()
    positive = scores.where("score > 0")
    share = F.col("score") / F.sum("score").over(every) * (total - F.count("*").over(every))
    rows = positive.withColumn("share", share).withColumn("whole", F.floor("share"))
    left = (total - F.count("*").over(every)) - F.sum("whole").over(every)
    rank = F.row_number().over(every.orderBy((F.col("share") - F.col("whole")).desc(), F.desc("score"), F.desc("label")))
    counted = rows.withColumn("n", (1 + F.col("whole") + (rank <= left).cast("long")).cast("long"))
    return scores.join(counted.select("label", "n"), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def surface_quotas(items: DataFrame, quotas: dict[str, int], total: int) -> DataFrame:
    """Per key, the hardest items of each surface in turn: what one surface has taken is gone for the next; then fillers up to ``total``.

    ``items`` (key, idx and a margin column a surface).  Taken rows move to a window group of
    their own, so a surface costs one window and no join.
    """
    rows = items.withColumn("taken", F.lit(None).cast("string"))
    for surface, n in quotas.items():
        place = F.row_number().over(Window.partitionBy("key", F.col("taken").isNull()).orderBy(surface, "idx"))
        rows = rows.withColumn("taken", F.when(F.col("taken").isNull() & (place <= n), surface).otherwise(F.col("taken")))
    first = F.col("taken").isNull().cast("int")
    mean = sum((F.col(s) for s in quotas), F.lit(0.0))
    place = F.row_number().over(Window.partitionBy("key").orderBy(first, mean, "idx"))
    return rows.withColumn("place", place).where(F.col("place") <= total).select("key", "idx", F.coalesce("taken", F.lit("filler")).alias("surface"))


def flatten_records(records: DataFrame, seed: str) -> DataFrame:
    """Labelled pairs of ``records`` (qid, positives, negatives) in a hash order that doesn't know the labels: qid, doc, label, pos.

    A text that stands on both sides keeps as many positive labels as it has positives.
    """
    pos = records.select("qid", F.explode("positives").alias("doc"), F.lit(1).alias("label"))
    neg = records.select("qid", F.explode("negatives").alias("doc"), F.lit(0).alias("label"))
    each = pos.unionByName(neg)
    same = Window.partitionBy("qid", "doc")
    each = each.withColumn("copy", F.row_number().over(same.orderBy(F.desc("label"))))
    order = stable_fraction(F.concat_ws(":", "qid", "doc", "copy"), seed)
    return each.withColumn("pos", (F.row_number().over(Window.partitionBy("qid").orderBy(order, "doc", "copy")) - 1).cast("long")).select("qid", "doc", "label", "pos")
