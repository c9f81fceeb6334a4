"""The retrieval lab: cases, labelled rows, teacher scores, candidate scores and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import params as PA
from tessera.operators import fusion as fuse
from tessera.operators import metrics as M
from tessera.operators import sampling as S
from tessera.operators import stats as ST

METRICS = ("map", "mrr", "ndcg")


def evaluate_cases(cases: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """Per case (name, expected parts of URLs) of ``results`` (name, rank, url): recall at ``k``, whether anything was hit, and the reciprocal of the first hit's rank, to four places."""
    parts = cases.select("name", F.explode(F.array_distinct("expected")).alias("part"), F.size("expected").alias("n"))
    top = results.where(F.col("rank") <= k).select("name", "rank", "url")
    found = parts.join(top, "name", "left").groupBy("name", "part", "n").agg(F.min(F.when(F.contains("url", F.regexp_replace("part", "/+$", "")), F.col("rank"))).alias("rank"))
    rows = found.groupBy("name").agg(F.count("rank").alias("matched"), F.max("n").alias("n"), F.min("rank").alias("first"))
    return rows.select("name", F.bround(F.col("matched") / F.col("n"), 4).alias("recall_at_k"), (F.col("matched") > 0).alias("hit"), F.bround(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("mrr"))


def suite_means(cases: DataFrame) -> DataFrame:
    """Means of ``evaluate_cases`` over a suite, to four places."""
    return cases.agg(F.count("*").alias("cases"), F.bround(F.avg("recall_at_k"), 4).alias("recall_at_k"), F.bround(F.avg(F.col("hit").cast("int")), 4).alias("hit_rate"), F.bround(F.avg("mrr"), 4).alias("mrr"))


def grouped_scores(scored: DataFrame) -> DataFrame:
    """A row per query of (qid, did, label, score): its labels and scores as arrays, in the order of did."""
    rows = scored.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("did", "label", "score"))).alias("x"))
    return rows.select("qid", F.transform("x", lambda r: r["label"]).alias("labels"), F.transform("x", lambda r: r["score"]).alias("scores"))


def subset_metrics(scored: DataFrame, keep: DataFrame) -> DataFrame:
    """Mean expected metrics of (qid, label, score) over the queries of ``keep`` (qid)."""
    return mean_tied(M.tie_aware_metrics(scored.join(keep.select("qid").distinct(), "qid", "left_semi")))


def mean_tied(by_query: DataFrame, *keys: str) -> DataFrame:
    return by_query.groupBy(*keys).agg(F.count("*").alias("queries"), *(F.avg(m).alias(m) for m in METRICS))


def candidate_scores(scored: DataFrame, blends: list[tuple[str, float]]) -> DataFrame:
    """(candidate, qid, did, label, score): the model's score, and its blend with each feature column by the query's deviations.

    ``scored`` (qid, did, label, score and feature columns); one pass, a window a query.
    """
    model = fuse.zscore(F.col("score"))
    every = [F.struct(F.lit("model").alias("candidate"), F.col("score").cast("double").alias("score"))]
    every += [F.struct(F.lit(f"{feature}_alpha_{alpha:g}").alias("candidate"), (model + alpha * fuse.zscore(F.col(feature))).alias("score")) for feature, alpha in blends]
    wide = scored.withColumn("every", F.array(*every))
    return wide.select("qid", "did", "label", F.inline("every"))


def candidate_metrics(candidates: DataFrame) -> DataFrame:
    """Mean expected metrics of each candidate; keys of candidate and query are joined, as metrics are made a query."""
    keyed = candidates.select(F.struct("candidate", "qid").alias("qid"), "label", "score")
    return mean_tied(M.tie_aware_metrics(keyed).select(F.col("qid.candidate").alias("candidate"), *METRICS), "candidate")


def margin_thresholds(margins: DataFrame, shares: list[float]) -> list[float]:
    """Quantiles of the queries' margins, each once: as many numbers as ``shares``."""
    found = margins.where(F.col("margin") < float("inf")).agg(F.percentile("margin", shares).alias("p")).first()["p"]
    return sorted({round(x, 9) for x in found or []})


def gated_candidates(candidates: DataFrame, margins: DataFrame, thresholds: list[float]) -> DataFrame:
    """All candidates, and for every pair of them and each threshold the base's scores with the alternate's in queries of a margin up to it.

    (candidate, method, base, alternate, threshold, gated, qid, did, label, score).  A
    document's candidate scores meet in one array, so pairs are made in the row.
    """
    wide = candidates.groupBy("qid", "did", "label").agg(F.array_sort(F.collect_list(F.struct("candidate", "score"))).alias("c")).join(margins.select("qid", "margin"), "qid")
    limits = F.array(*(F.lit(float(t)) for t in thresholds)) if thresholds else F.array().cast("array<double>")

    def row(method: str, base: Column, other: Column, limit: Column, score: Column) -> Column:
        gated = F.when(limit.isNotNull(), F.col("margin") <= limit).otherwise(False)
        return F.struct(F.lit(method).alias("method"), base.alias("base"), other.alias("alternate"), limit.alias("threshold"), gated.alias("gated"), score.alias("score"))

    none = F.lit(None)
    direct = F.transform("c", lambda a: row("direct", a["candidate"], none.cast("string"), none.cast("double"), a["score"]))
    pairs = F.flatten(F.transform("c", lambda a: F.flatten(F.transform("c", lambda b: F.transform(F.when(a["candidate"] != b["candidate"], limits).otherwise(F.slice(limits, 1, 0)), lambda t: row("low_margin_gate", a["candidate"], b["candidate"], t, F.when(F.col("margin") <= t, b["score"]).otherwise(a["score"])))))))
    return wide.select("qid", "did", "label", F.inline(F.concat(direct, pairs)))


def search_candidates(candidates: DataFrame, margins: DataFrame, thresholds: list[float]) -> DataFrame:
    """Every direct and gated candidate with its mean expected metrics and number of gated queries, ranked by MAP, MRR, nDCG, then direct ones, fewer gated queries and names."""
    rows = gated_candidates(candidates, margins, thresholds)
    key = ["method", "base", "alternate", "threshold"]
    by_query = M.tie_aware_metrics(rows.select(F.struct(*key, "gated", "qid").alias("qid"), "label", "score"))
    means = by_query.select(*(F.col(f"qid.{k}").alias(k) for k in key), F.col("qid.gated").cast("int").alias("gated"), *METRICS)
    means = means.groupBy(*key).agg(F.sum("gated").alias("gated"), *(F.avg(m).alias(m) for m in METRICS))
    order = [F.round(m, 9).desc() for m in METRICS] + [F.when(F.col("method") == "direct", 0).otherwise(1), "gated", "base", "alternate", "threshold"]
    # The grid is a parameter, and has a row a candidate.
    return means.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def reranker_scores(original_pos: Column, original_neg: Column, pos: Column, neg: Column) -> tuple[Column, Column]:
    """The original scores of both sides where both have some, else the present ones (none: an empty array)."""
    some = (F.size(F.coalesce(original_pos, F.array().cast("array<double>"))) > 0) & (F.size(F.coalesce(original_neg, F.array().cast("array<double>"))) > 0)
    none = F.array().cast("array<double>")
    return F.when(some, original_pos).otherwise(F.coalesce(pos, none)), F.when(some, original_neg).otherwise(F.coalesce(neg, none))


def surface_scores(pos: Column, neg: Column, surfaces: list[str]) -> Column:
    """A struct of arrays of (surface, pos, neg) from two maps of score arrays; null where a surface lacks a side."""
    rows = F.array(*(F.struct(F.lit(s).alias("surface"), F.try_element_at(pos, F.lit(s)).alias("pos"), F.try_element_at(neg, F.lit(s)).alias("neg")) for s in surfaces))
    whole = F.forall(rows, lambda r: (F.coalesce(F.size(r["pos"]), F.lit(0)) > 0) & (F.coalesce(F.size(r["neg"]), F.lit(0)) > 0))
    return F.when(whole, rows)


def training_items(rows: DataFrame) -> DataFrame:
    """(key, kind, item, query, text) of each positive and negative text of ``rows`` (key, query, pos, neg)."""
    sides = [rows.select("key", F.lit(kind).alias("kind"), "query", F.posexplode(kind).alias("item", "text")) for kind in ("pos", "neg")]
    return sides[0].unionByName(sides[1])


def teacher_summary(rows: DataFrame) -> DataFrame:
    """Scores and margins of ``rows`` (pos and neg scores, old_pos and old_neg scores of another model): counts, means, how often positives win, and how the two models' margins go together.

    One aggregation; rows without a score on either side count for the pairs alone.
    """
    both = (F.size("pos") > 0) & (F.size("neg") > 0)
    old = both & (F.size("old_pos") > 0) & (F.size("old_neg") > 0)
    total = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda a, x: a + x))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    margin = F.when(both, F.array_max("pos") - F.array_max("neg"))
    before = F.when(old, F.array_max("old_pos") - F.array_max("old_neg"))
    whole = F.when(both, F.array_min("pos") > F.array_max("neg"))
    n_pos, n_neg = F.sum(F.size("pos")), F.sum(F.size("neg"))
    mean_pos, mean_neg = F.try_divide(total(F.col("pos")), n_pos), F.try_divide(total(F.col("neg")), n_neg)
    return rows.agg(
        F.count(margin).alias("rows_with_scores"), n_pos.alias("positive_pairs"), n_neg.alias("negative_pairs"), mean_pos.alias("mean_positive"), mean_neg.alias("mean_negative"), (mean_pos - mean_neg).alias("mean_difference"),
        F.avg(margin).alias("mean_margin"), F.avg(F.when(both, mean(F.col("pos")) - mean(F.col("neg")))).alias("mean_row_difference"),
        F.count_if(margin > 0).alias("best_wins"), F.try_divide(F.count_if(margin > 0), F.count(margin)).alias("best_win_rate"), F.count_if(whole).alias("all_win"), F.try_divide(F.count_if(whole), F.count(margin)).alias("all_win_rate"),
        ST.pearson(before, F.when(old, margin)).alias("margin_correlation"),
    )


def source_counts(rows: DataFrame) -> DataFrame:
    """How often each source gave a negative: (source, n) of ``rows`` (neg_sources)."""
    return rows.select(F.explode("neg_sources").alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def training_summary(rows: DataFrame) -> DataFrame:
    """Rows, expanded triples, and mean and extremes of the target margins of ``rows`` (neg, margins, teacher_scores, base_scores)."""
    each = rows.select(F.size("neg").alias("n"), "margins", F.col("teacher_scores").isNotNull().cast("long").alias("t"), F.col("base_scores").isNotNull().cast("long").alias("b"))
    total, number = F.sum(F.aggregate("margins", F.lit(0.0), lambda a, x: a + x)), F.sum(F.size("margins"))
    return each.agg(F.count("*").alias("rows"), F.sum("n").alias("triples"), F.try_divide(total, number).alias("mean"), F.min(F.array_min("margins")).alias("least"), F.max(F.array_max("margins")).alias("most"), F.sum("t").alias("with_teacher"), F.sum("b").alias("with_base"))


def best_delta(comparisons: DataFrame, *keys: str) -> DataFrame:
    """The comparison (label, base, student, delta) with the greatest delta of each group; the least label of equal ones."""
    best = F.min(F.struct((-F.col("delta")).alias("o"), "label", "base", "student")).alias("b")
    return comparisons.groupBy(*keys).agg(best).select(*keys, "b.label", "b.base", "b.student", (-F.col("b.o")).alias("delta"))


def best_against_best(scores: DataFrame, *keys: str) -> DataFrame:
    """The best base and the best student of (label, base, student), whatever their labels, and the difference."""
    best = lambda c: F.min(F.struct((-F.col(c)).alias("o"), "label")).alias(c)
    rows = scores.groupBy(*keys).agg(best("base"), best("student"))
    return rows.select(*keys, F.col("base.label").alias("base_label"), F.col("student.label").alias("student_label"), (-F.col("base.o")).alias("base"), (-F.col("student.o")).alias("student"), (F.col("base.o") - F.col("student.o")).alias("delta"))


def labelled(comparisons: DataFrame, label: str, *keys: str) -> DataFrame:
    """The comparison of one label in each group; a group without it is an error."""
    found = comparisons.groupBy(*keys).agg(F.max_by("delta", F.col("label") == label).alias("delta"), F.max(F.col("label") == label).alias("there"))
    return found.select(*keys, F.when(F.col("there"), F.col("delta")).otherwise(F.raise_error(F.lit(f"no comparison of {label}")).cast("double")).alias("delta"))


def matrix_summary(rows: DataFrame, metrics: list[str], base: str, other: str) -> DataFrame:
    """Macro averages over tasks of (precision, task, digest, metrics) for two precisions, and their difference, a row a metric.

    A task whose candidates differ between precisions, one that a precision lacks, and a
    metric outside 0 and 1 are errors.
    """
    own = Window.partitionBy("task")
    known = F.max(F.col("precision") == base).over(own) & F.max(F.col("precision") == other).over(own) & (F.min("digest").over(own) == F.max("digest").over(own))
    inside = F.lit(True)
    for m in metrics:
        inside = inside & F.col(m).between(0, 1)
    checked = rows.withColumn("ok", F.when(known & inside, True).otherwise(F.raise_error(F.concat(F.lit("not comparable: "), "task")).cast("boolean"))).where("ok")
    long = checked.select("precision", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))))
    mean = lambda p: F.avg(F.when(F.col("precision") == p, F.col("value")))
    return long.groupBy("metric").agg(mean(base).alias("base"), mean(other).alias("other"), (mean(other) - mean(base)).alias("difference"))


def eligible(rows: DataFrame, checks: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks, and (reason, n) of those that don't, by the first check that they fail; ``eligible`` counts the others."""
    reason = F.lit("eligible")
    for name, failed in reversed(checks):
        reason = F.when(failed, name).otherwise(reason)
    marked = rows.withColumn("_reason", reason)
    return marked.where("_reason = 'eligible'").drop("_reason"), marked.groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))


def training_split(split: Column, allowed: list[str] = ("train",)) -> Column:
    """A row's source split, null where it may not be used."""
    return F.when(split.isin(*allowed), split)


def available_mix(strata: Column, least: dict[str, int]) -> Column:
    """Whether an array of strata has at least so many of each."""
    out = F.lit(True)
    for name, n in least.items():
        out = out & (F.size(F.filter(strata, lambda s: s == name)) >= n)
    return out


def paired_margins(pos: Column, neg: Column) -> Column:
    """Differences of positives and negatives side by side, as far as both go."""
    both = F.least(F.size(pos), F.size(neg))
    return F.zip_with(F.slice(pos, F.lit(1), both), F.slice(neg, F.lit(1), both), lambda p, n: p - n)


def reciprocal_ranks(scored: DataFrame, *surfaces: str) -> DataFrame:
    """The reciprocal rank of each document on each score column, ties by did."""
    return scored.select("qid", "did", *((1.0 / F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), "did"))).alias(c) for c in surfaces))


def wanted_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``wanted`` (did) with the text of ``docs`` (did, text) and whether there is one."""
    return wanted.join(docs.select("did", "text").withColumn("found", F.lit(True)), "did", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def load_task(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, exclude_anchors: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Queries (qid, query), documents (did, text), judgements (qid, did, rel) and exclusions (qid, did) of a task.

    Inputs have JSON ``row``s and a ``seq``; of rows with one id the last counts.  Texts are
    the first field that isn't empty; the anchor that a query must not find is in its row.
    """
    field = lambda *names: PA.first_text(F.col("row"), list(names))
    anchor = F.coalesce(field("meta_anchor_code_id", "meta.anchor_code_id"), F.nullif(F.regexp_extract(F.get_json_object("row", "$.meta"), r"'anchor_code_id':\s*['\"]([^'\"]*)['\"]", 1), F.lit("")))
    q = last_of(queries.select(field("query_id").alias("qid"), F.coalesce(field("query", "code", "text"), F.lit("")).alias("query"), anchor.alias("anchor"), "seq"), "qid", "seq").drop("seq")
    d = last_of(corpus.select(field("doc_id", "code_id", "id").alias("did"), F.coalesce(field("text", "code"), F.lit("")).alias("text"), "seq"), "did", "seq").drop("seq")
    pair = last_of(qrels.select(F.struct(field("query_id").alias("qid"), field("doc_id").alias("did")).alias("key"), F.get_json_object("row", "$.relevance").cast("int").alias("rel"), "seq"), "key", "seq")
    excluded = q.where("anchor is not null").select("qid", F.col("anchor").alias("did")) if exclude_anchors else q.where("false").select("qid", F.col("anchor").alias("did"))
    return q.drop("anchor"), d, pair.select("key.qid", "key.did", "rel"), excluded


def rerank_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, query, positives, negatives) of JSON ``row``s (seq, row) that have all of these, and (status, n): how many were used and skipped."""
    texts = lambda keys: F.coalesce(*(F.when(F.size(t) > 0, t) for t in (PA.text_list(F.get_json_object("row", f"$.{k}")) for k in keys)))
    found = rows.select(
        F.coalesce(PA.first_text(F.col("row"), PA.ID_KEYS), F.col("seq").cast("string")).alias("qid"), PA.first_text(F.col("row"), PA.QUERY_KEYS).alias("query"), texts(PA.POSITIVE_KEYS).alias("positives"), texts(PA.NEGATIVE_KEYS).alias("negatives")
    )
    usable = F.col("query").isNotNull() & F.col("positives").isNotNull() & F.col("negatives").isNotNull()
    return found.where(usable), found.groupBy(F.when(usable, "used").otherwise("skipped").alias("status")).agg(F.count("*").alias("n"))


def judged_relevance(judgements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positives (qid, did) and judged negatives of (qid, did, score)."""
    return judgements.where("score > 0").select("qid", "did"), judgements.where("score <= 0").select("qid", "did")


def first_metrics(*candidates: Column) -> Column:
    """The first map of metrics that has any; an error where none has."""
    some = F.coalesce(*(F.when(F.size(c) > 0, c) for c in candidates))
    return F.when(some.isNotNull(), some).otherwise(F.raise_error(F.lit("no metrics")).cast("map<string,double>"))


def research_union(batches: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of all steps (step, url, ...) by canonical URL, the first step's kept; and a summary of ``meta`` (step, raw_results, elapsed_ms): sum, longest, steps."""
    first = Window.partitionBy(F.regexp_replace("url", "/+$", "")).orderBy("step", "pos")
    kept = batches.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    return kept, meta.agg(F.sum("raw_results").alias("raw_results"), F.max("elapsed_ms").alias("elapsed_ms"), F.count("*").alias("research_steps"))


def row_mean_order(sheets: DataFrame) -> DataFrame:
    """(sheet, name, mean, place) of rows (sheet, name, cells) by the mean of their numbers, the best first; rows without a number are left out."""
    numbers = F.filter("cells", lambda c: c.isNotNull())
    rows = sheets.where(F.size(numbers) > 0).select("sheet", "name", (F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers)).alias("mean"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("sheet").orderBy(F.round("mean", 9).desc(), "name")))


def id_set_digest(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, digest): a digest of a group's ids that doesn't depend on their order."""
    return rows.select(key, value.alias("id")).groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n"), 256).alias("digest"))


def order_invariant(runs: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(task, same_candidates, same_metrics) over runs (task, digest, metric) in different orders."""
    return runs.groupBy("task").agg((F.min("digest") == F.max("digest")).alias("same_candidates"), (F.max("metric") - F.min("metric") <= tolerance).alias("same_metrics"))


def prepared_splits(rows: DataFrame, items: DataFrame, checks: list[tuple[str, Column]], held_out: float, seed: str, order: list[Column], quotas: dict[str, int], total: int, most_train: int = 0, most_eval: int = 0) -> tuple[DataFrame, DataFrame]:
    """Eligible rows (key), split by hash and cut, with the negatives chosen for each from ``items`` (key, idx, margin); and (reason, n) of the others.

    Rows for which fewer than ``total`` negatives can be chosen are left out; the result has
    a row a negative: split, place, key, idx, stratum, filler.
    """
    kept, reasons = eligible(rows, checks)
    split = S.split_rows(kept, "key", held_out, seed, order, most_train, most_eval).select("key", "split", "place")
    chosen = S.choose_negatives(items.join(split.select("key"), "key", "left_semi"), quotas, total, seed)
    whole = chosen.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= total).select("key")
    return chosen.join(whole, "key", "left_semi").join(split, "key").select("split", "place", "key", "idx", "stratum", "filler"), reasons


def sampled_corpus(docs: DataFrame, judged: DataFrame, size: int, seed: str) -> DataFrame:
    """All documents (did, ...) that are judged (did), and others up to ``size`` in all, in the order of a stable hash."""
    own = docs.join(judged.select("did").distinct(), "did", "left_semi")
    others = docs.join(judged.select("did").distinct(), "did", "left_anti")
    return own.unionByName(others.orderBy(S.stable_fraction(F.col("did"), seed), "did").limit(max(0, size - own.count())))
