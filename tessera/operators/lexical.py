"""Lexical features of query and document pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Queries sent to every task at a time; more are scored in further passes.
QUERY_BLOCK = 4096
#: Pairs that a task scores at a time.
PAIRS = 1 << 18


def lexical_scores(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs`` (qid, did) with ``score``: F1 of the token overlap, and 0.02 log1p of the counts of each shared token of two characters or more.

    ``queries`` (qid, tokens), ``docs`` (did, tokens); pairs without tokens score 0.
    """
    q = queries.select("qid", F.size("tokens").alias("qn"), F.explode("tokens").alias("token")).groupBy("qid", "token").agg(F.count("*").alias("qc"), F.first("qn").alias("qn"))
    d = docs.select("did", F.size("tokens").alias("dn"), F.explode("tokens").alias("token")).groupBy("did", "token").agg(F.count("*").alias("dc"), F.first("dn").alias("dn"))
    shared = pairs.join(q, "qid").join(d, ["did", "token"])
    sums = shared.groupBy("qid", "did").agg(
        F.sum(F.least("qc", "dc")).alias("overlap"), F.first("qn").alias("qn"), F.first("dn").alias("dn"), F.sum(F.when(F.length("token") >= 2, F.log1p(F.col("qc") + F.col("dc"))).otherwise(0.0)).alias("bonus")
    )
    p, r = F.col("overlap") / F.col("dn"), F.col("overlap") / F.col("qn")
    return pairs.join(sums.select("qid", "did", (2 * p * r / F.greatest(p + r, F.lit(1e-12)) + 0.02 * F.col("bonus")).alias("score")), ["qid", "did"], "left").na.fill(0.0, ["score"])


class _Terms:
    """Which of a block of queries has which token, and how often."""

    def __init__(self, tokens: list[list[str]]) -> None:
        self.queries, self.n = len(tokens), np.array([len(t) for t in tokens], np.int64)
        flat = pa.array([x for t in tokens for x in t], pa.string()).dictionary_encode()
        self.words = flat.dictionary
        self.long = pc.greater_equal(pc.utf8_length(self.words), 2).to_numpy(zero_copy_only=False)
        code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key, self.count = np.unique(code * self.queries + np.repeat(np.arange(self.queries), self.n), return_counts=True)
        self.owner = key % max(self.queries, 1)
        self.first = np.searchsorted(key, np.arange(len(self.words) + 1) * self.queries)

    def _shared(self, docs: pa.ListArray) -> tuple[np.ndarray, ...]:
        """Cell (document, then query), count in the document, count in the query and token of all that they share."""
        code = pc.index_in(docs.flatten(), value_set=self.words)
        known = code.is_valid().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(docs)), docs.value_lengths().fill_null(0).to_numpy())[known]
        key, times = np.unique(doc * max(len(self.words), 1) + code.drop_null().to_numpy().astype(np.int64), return_counts=True)
        doc, token = np.divmod(key, max(len(self.words), 1))
        size = self.first[token + 1] - self.first[token]
        at = np.repeat(self.first[token] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.repeat(doc, size) * self.queries + self.owner[at], np.repeat(times, size), self.count[at], np.repeat(token, size)

    def lexical(self, docs: pa.ListArray) -> np.ndarray:
        """``lexical_scores`` of each document (a row) with each query."""
        cell, dc, qc, token = self._shared(docs)
        sums = (np.bincount(cell, x, len(docs) * self.queries).reshape(len(docs), self.queries) for x in (np.minimum(dc, qc), np.where(self.long[token], np.log1p(dc + qc), 0.0)))
        overlap, bonus = sums
        p, r = overlap / np.maximum(docs.value_lengths().fill_null(0).to_numpy(), 1)[:, None], overlap / np.maximum(self.n, 1)
        return 2 * p * r / np.maximum(p + r, 1e-12) + 0.02 * bonus

    def recall(self, docs: pa.ListArray) -> np.ndarray:
        """Share of each query's tokens that a document has, where both have each token once; 0 where the query has none."""
        return np.bincount(self._shared(docs)[0], minlength=len(docs) * self.queries).reshape(len(docs), self.queries) / np.maximum(self.n, 1)


def _every_pair(queries: DataFrame, docs: DataFrame, features: dict[str, tuple[str, str]], block: int) -> DataFrame:
    """All pairs of ``queries`` (qid, token arrays) and ``docs`` (did, token arrays), with features named by the arrays they compare.

    The query set is the stated one: it is sent in blocks of at most ``block`` queries, each
    block one pass over ``docs``; no pair is shuffled.
    """
    spark, found, n = docs.sparkSession, None, queries.count()
    passes = max(1, -(-n // block))
    part = F.pmod(F.xxhash64("qid"), F.lit(passes))
    kinds = ", ".join(["qid long", "did long", *(f"{name} double" for name in features)])

    def scored(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, terms = sent.value
            step = max(1, PAIRS // max(len(qids), 1))
            for batch in batches:
                for lo in range(0, batch.num_rows if len(qids) else 0, step):
                    own = batch.slice(lo, step)
                    values = [(terms[q].recall if q.startswith("grams") else terms[q].lexical)(own.column(d)).ravel() for q, d in features.values()]
                    pairs = [pa.array(np.tile(np.arange(len(qids)), own.num_rows)), pa.array(np.repeat(np.arange(own.num_rows), len(qids)))]
                    yield pa.record_batch([qids.take(pairs[0]), own.column("did").take(pairs[1]), *map(pa.array, values)], names=["qid", "did", *features])

        return docs.mapInArrow(run, kinds)

    for turn in range(passes):
        own = queries.where(F.coalesce(part, F.lit(0)) == turn).collect() if n else []
        terms = {c: _Terms([r[c] or [] for r in own]) for c in queries.columns if c != "qid"}
        some = scored(spark.sparkContext.broadcast((pa.array([r["qid"] for r in own], pa.int64()), terms)))
        found = some if found is None else found.unionByName(some)
    return found


def every_lexical_score(queries: DataFrame, docs: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """``lexical_scores`` of every query (qid, tokens) with every document (did, tokens)."""
    return _every_pair(queries.select(F.col("qid").cast("long"), "tokens"), docs.select(F.col("did").cast("long"), "tokens"), {"score": ("tokens", "tokens")}, block)


def feature_columns(queries: DataFrame, docs: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """Seven features of every query (qid, text) with every document (did, text): whole, head and title overlap, and CJK n-gram recall."""
    text = F.col("text")
    q = queries.select(F.col("qid").cast("long"), T.rerank_tokens(text).alias("tokens"), T.cjk_ngrams(text, 2).alias("grams2"), T.cjk_ngrams(text, 3).alias("grams3"))
    head, title = T.head_text(text), T.title_text(text)
    columns = {"lexical": T.rerank_tokens(text), "head_lexical": T.rerank_tokens(head), "title_lexical": T.rerank_tokens(title)}
    grams = {"doc_bigram": (text, 2), "head_bigram": (head, 2), "title_bigram": (title, 2), "title_trigram": (title, 3)}
    d = docs.select(F.col("did").cast("long"), *(c.alias(n) for n, c in columns.items()), *(T.cjk_ngrams(c, k).alias(n) for n, (c, k) in grams.items()))
    return _every_pair(q, d, {n: ("tokens", n) for n in columns} | {n: (f"grams{k}", n) for n, (_, k) in grams.items()}, block)
