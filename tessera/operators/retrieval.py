"""Lexical, sparse and dense retrieval: BM25, sparse products, exact top-k over vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Query vectors sent to every task at a time; more are searched in further passes.
QUERY_BLOCK = 4096


def term_counts(tokens: DataFrame, key: str) -> DataFrame:
    """(key, token, tf) from a token array a row."""
    return tokens.select(key, F.explode("tokens").alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def idf_table(postings: DataFrame, totals: DataFrame) -> DataFrame:
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(totals).select("token", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg_len")


def bm25(queries: DataFrame, docs: DataFrame, k1: float, b: float, query_weight: bool, least_len: float = 1e-9) -> DataFrame:
    """(qid, did, score) of every pair that shares a token.

    ``queries`` (qid, tokens), ``docs`` (did, tokens).  Only tokens that a query has are
    exploded further than the scan; totals are one row.  ``query_weight``: repeats in the query
    count by ``1 + log1p(times)``, else its distinct tokens count once.
    """
    totals = docs.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avg_len"))
    terms = term_counts(queries, "qid").withColumnRenamed("tf", "qtf")
    own = docs.select("did", F.size("tokens").alias("length"), F.explode("tokens").alias("token")).join(terms.select("token").distinct(), "token", "left_semi")
    postings = own.groupBy("token", "did").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    weighed = postings.join(idf_table(postings, totals), "token")
    saturation = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.greatest(F.col("avg_len"), F.lit(least_len))))
    part = F.col("idf") * saturation * ((1 + F.log1p("qtf")) if query_weight else F.lit(1.0))
    return weighed.join(terms, "token").groupBy("qid", "did").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int, digits: int = 8) -> DataFrame:
    """Rows ranked 1 to ``k`` in each query, by the score to ``digits`` places, then did."""
    order = Window.partitionBy("qid").orderBy(F.round("score", digits).desc(), "did")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sparse_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, did, score): products of token weights, from (qid, token, weight) and (did, token, weight)."""
    return queries.withColumnRenamed("weight", "qw").join(docs, "token").groupBy("qid", "did").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))


def dense_top_k(queries: DataFrame, docs: DataFrame, k: int, block: int = QUERY_BLOCK, width: int | None = None) -> DataFrame:
    """(qid, did, score, rank) of the ``k`` largest inner products of each query but with itself.

    ``queries`` (qid, v), ``docs`` (did, v).  The query set is the stated one: it is sent in
    blocks of at most ``block`` vectors, each block one pass over ``docs``; a task keeps its own best
    ``k`` a query, so what is shuffled is tasks x queries x k rows.
    """
    found, n = None, queries.count()
    passes = max(1, -(-n // block))
    part = F.pmod(F.xxhash64("qid"), F.lit(passes))
    for turn in range(passes):
        own = queries.select("qid", "v").where(part == turn).orderBy("qid").collect() if n else []
        matrix = np.array([r["v"] for r in own], np.float64).reshape(len(own), len(own[0]["v"]) if own else 0)
        best = _search(docs, np.array([r["qid"] for r in own], np.int64), matrix, k, width)
        found = best if found is None else found.unionByName(best)
    return top_k(found, k)


def containing(queries: DataFrame, docs: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, did) of documents whose text contains a query's text.

    ``queries`` (qid, text), ``docs`` (did, text).  The stated query set is sent in blocks
    of ``block`` texts; a task looks for each of a block in its own documents.
    """
    passes, found = max(1, -(-queries.count() // block)), None
    for turn in range(passes):
        own = queries.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("qid"), F.lit(passes)) == turn)).select(F.col("qid").cast("long"), "text").collect()
        sent = docs.sparkSession.sparkContext.broadcast([(r["qid"], r["text"]) for r in own])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = batch.column("text")
                for qid, wanted in sent.value:
                    there = batch.column("did").filter(pc.fill_null(pc.match_substring(text, wanted), False))
                    if len(there):
                        yield pa.record_batch([pa.array([qid] * len(there), pa.int64()), there], names=["qid", "did"])

        part = docs.select(F.col("did").cast("long"), "text").mapInArrow(run, "qid long, did long")
        found = part if found is None else found.unionByName(part)
    return found


def late_interaction_top_k(queries: DataFrame, docs: DataFrame, k: int, width: int, block: int = QUERY_BLOCK) -> DataFrame:
    """``dense_top_k`` by ``late_interaction`` with every document; ``v`` holds a row's token vectors of ``width`` end to end, as many in each row."""
    return dense_top_k(queries.withColumn("v", F.slice("v", width + 1, F.size("v") - width)), docs, k, block, width)


def _token_scores(vectors: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Mean over a query's tokens of the best product with a document's tokens."""
    q, d = vectors.reshape(len(vectors), -1, width), values.reshape(len(values), -1, width)
    out = np.zeros((len(q), len(d)))
    for i in range(q.shape[1]):
        best = q[:, i] @ d[:, 0].T
        for j in range(1, d.shape[1]):
            np.maximum(best, q[:, i] @ d[:, j].T, out=best)
        out += best
    return out / q.shape[1]


def _search(docs: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, width: int | None = None) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, vectors = sent.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows or not len(qids):
                continue
            dids = batch.column("did").to_numpy()
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            scores = np.round(vectors @ values.T if width is None else _token_scores(vectors, values, width), 12)
            scores[qids[:, None] == dids[None]] = -np.inf
            held.append((np.broadcast_to(dids, scores.shape), scores))
            if sum(s.shape[1] for _, s in held) > 4 * k + 4096:
                held = [_best(held, k)]
        if held:
            dids, scores = _best(held, k)
            rows = np.repeat(np.arange(len(qids)), scores.shape[1])
            keep = np.isfinite(scores.ravel())
            yield pa.record_batch([pa.array(qids[rows][keep]), pa.array(dids.ravel()[keep]), pa.array(scores.ravel()[keep])], names=["qid", "did", "score"])

    return docs.select(F.col("did").cast("long"), "v").mapInArrow(run, "qid long, did long, score double")


def _best(held: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    dids, scores = np.concatenate([d for d, _ in held], axis=1), np.concatenate([s for _, s in held], axis=1)
    order = np.lexsort([dids, -np.round(scores, 8)], axis=1)[:, :k]
    return np.take_along_axis(dids, order, 1), np.take_along_axis(scores, order, 1)


def merge_top_k(runs: list[DataFrame], k: int) -> DataFrame:
    """The best ``k`` of several runs (qid, did, score) of disjoint documents."""
    out = runs[0].select("qid", "did", "score")
    for run in runs[1:]:
        out = out.unionByName(run.select("qid", "did", "score"))
    return top_k(out, k)


def gather_candidates(dense: DataFrame, sparse: DataFrame, dense_weight: float, sparse_weight: float, limit: int) -> DataFrame:
    """Weighted sum over the union of two runs (a missing score counts 0), best ``limit``."""
    both = dense.select("qid", "did", F.col("score").alias("a")).join(sparse.select("qid", "did", F.col("score").alias("b")), ["qid", "did"], "full_outer")
    return top_k(both.select("qid", "did", (dense_weight * F.coalesce("a", F.lit(0.0)) + sparse_weight * F.coalesce("b", F.lit(0.0))).alias("score")), limit)


def late_interaction(queries: DataFrame, docs: DataFrame, candidates: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Mean over a query's tokens (the first left out) of the best product with a document's tokens, for candidate pairs.

    ``queries`` (qid, pos, v), ``docs`` (did, v): a token vector a row.
    """
    from tessera.functions.arrays import dot

    q = queries.where("pos > 0").select("qid", "pos", F.col("v").alias("qv"))
    best = candidates.join(q, "qid").join(docs, "did").groupBy("qid", "did", "pos").agg(F.max(dot(F.col("qv"), F.col("v"))).alias("best"))
    return best.groupBy("qid", "did").agg((F.avg("best") / temperature).alias("score"))
