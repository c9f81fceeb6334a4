"""Claims of answers and their citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Supported claims of less support than this are judged again.
JUDGE_BELOW = 0.34


def split_answers(answers: DataFrame) -> DataFrame:
    """Claims of ``answers`` (qid, answer): qid, pos, claim, citation_ids; a part without citations takes its line's."""
    lines = answers.select("qid", F.posexplode(F.split("answer", "\r\n|\n|\r")).alias("line_no", "line"))
    lines = lines.withColumn("line", T.strip_list_marker(F.trim("line"))).where("line != ''").withColumn("line_ids", T.citation_ids(F.col("line")))
    parts = lines.select("qid", "line_no", "line_ids", F.posexplode(T.split_claims(F.col("line"))).alias("part_no", "part"))
    parts = parts.withColumn("own", T.citation_ids(F.col("part"))).withColumn("ids", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("line_ids")))
    claims = parts.select("qid", (F.col("line_no") * 10000 + F.col("part_no")).cast("long").alias("pos"), T.clean_claim(F.col("part")).alias("claim"), F.col("ids").alias("citation_ids"))
    return claims.where(T.keep_claim(F.col("claim"), F.col("citation_ids")))


def verify(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``claims`` (qid, pos, claim, citation_ids) with status and support by the cited ``evidence`` (qid, id, title, passage).

    Support is the share of a claim's words that a cited source has, and 0.04 if its title has
    one; the best source counts.
    """
    e = evidence.select("qid", F.col("id").alias("cited"), T.support_tokens(F.col("title")).alias("et"), T.support_tokens(F.concat_ws(" ", "title", "passage")).alias("ep"))
    cited = claims.select("qid", "pos", F.array_distinct(T.support_tokens(F.col("claim"))).alias("ct"), F.explode("citation_ids").alias("cited")).join(e, ["qid", "cited"])
    n = F.size("ct")
    share = F.size(F.array_intersect("ct", "ep")) / n + F.when(F.size(F.array_intersect("ct", "et")) > 0, 0.04).otherwise(0.0)
    one = F.when((n == 0) | (F.size("ep") == 0), 0.0).otherwise(F.least(share, F.lit(1.0)))
    best = cited.withColumn("s", one).groupBy("qid", "pos").agg(F.max("s").alias("support"))
    out = claims.join(best, ["qid", "pos"], "left")
    status = (
        F.when(F.size("citation_ids") == 0, "missing_citation")
        .when(F.col("support").isNull(), "unsupported")
        .when(F.col("support") >= 0.22, "supported")
        .when(F.col("support") >= 0.08, "weak")
        .otherwise("needs_review")
    )
    scored = out.withColumn("status", status).withColumn("support", F.coalesce("support", F.lit(0.0)))
    return scored.withColumn("needs_judge", needs_judge(F.col("status"), F.col("support")))


def merge_judgements(claims: DataFrame, judgements: DataFrame) -> DataFrame:
    """``claims`` (qid, pos, status, support) updated by ``judgements`` (qid, pos, verdict, confidence): known verdicts, confidence within 0 and 1."""
    j = claims.join(judgements, ["qid", "pos"], "left")
    judged = F.col("verdict").isNotNull() | F.col("confidence").isNotNull()
    known = F.lower("verdict").isin("supported", "weak", "contradicted", "insufficient")
    return j.select(
        "qid",
        "pos",
        F.when(known, F.lower("verdict")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("confidence").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))).otherwise(F.col("support")).alias("support"),
        F.when(judged, "judge").otherwise("lexical").alias("verifier"),
    )


def needs_judge(status: Column, support: Column) -> Column:
    """Whether a claim's support is to be judged again: it isn't called supported, or not by much."""
    return (status != "supported") | (support < JUDGE_BELOW)
