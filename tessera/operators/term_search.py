"""Search of all documents by shared terms, where a stated query set is sent to the tasks.

As exact vector search does, every task scores its own documents against a block of the
queries and keeps its best ``k`` of each, so tasks x queries x k rows are shuffled,
whatever number of documents shares a word with a query.  Documents are tokenised once: the
first pass leaves each one's length and its counts of the block's terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators._lineage import cut
from tessera.operators.retrieval import QUERY_BLOCK, _best, top_k

#: Documents and matches that a task scores at a time.
ROWS, MATCHES = 4096, 1 << 22

#: Weight of matches from (counts in the document, its length, the term's number), and of terms in queries from their counts.
DocumentWeight = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
QueryWeight = Callable[[np.ndarray], np.ndarray]


def bm25_top_k(queries: DataFrame, docs: DataFrame, k: int, k1: float, b: float, query_weight: bool, least_len: float = 1e-9) -> DataFrame:
    """(qid, did, score, rank): the ``k`` best documents of each query by BM25, of those that share a token.

    ``queries`` (qid, tokens), ``docs`` (did, tokens); ids are longs, null tokens are none.
    ``query_weight``: repeats in the query count by ``1 + log1p(times)``, else once.
    """

    def prepare(n: int, total: int, df: np.ndarray) -> DocumentWeight:
        idf, mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), max(total / max(n, 1), least_len)
        return lambda tf, length, term: idf[term] * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / mean))

    return _search(queries, docs, k, prepare, (lambda times: 1 + np.log1p(times)) if query_weight else np.ones_like)


def root_count_top_k(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The same by products of the square roots of the counts of shared tokens."""
    return _search(queries, docs, k, lambda n, total, df: lambda tf, length, term: np.sqrt(tf), np.sqrt)


def _search(queries: DataFrame, docs: DataFrame, k: int, prepare: Callable[[int, int, np.ndarray], DocumentWeight], query_weight: QueryWeight) -> DataFrame:
    spark, n = docs.sparkSession, queries.count()
    passes, found = max(1, -(-n // QUERY_BLOCK)), None
    for turn in range(passes):
        own = queries.select(F.col("qid").cast("long").alias("qid"), "tokens").where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == turn).toArrow().combine_chunks()
        terms = _Terms(own, query_weight)
        matched = cut(docs.select(F.col("did").cast("long").alias("did"), "tokens").mapInArrow(_matcher(terms.words), "did long, length int, term array<int>, tf array<int>"))
        totals = matched.agg(F.count("*").alias("n"), F.sum("length").alias("total")).first()
        df = np.zeros(len(terms.words))
        for r in matched.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():
            df[r["t"]] = r["n"]
        sent = spark.sparkContext.broadcast((terms, df, totals["n"], totals["total"] or 0))
        best = matched.where(F.size("term") > 0).mapInArrow(_scorer(sent, k, prepare), "qid long, did long, score double")
        found = best if found is None else found.unionByName(best)
    return top_k(found, k)


class _Terms:
    """A block of queries: its distinct tokens, and by token the queries that have it and their weights."""

    def __init__(self, queries: pa.Table, query_weight: QueryWeight) -> None:
        self.ids = queries.column("qid").to_numpy()
        tokens = queries.column("tokens").combine_chunks() if queries.num_rows else pa.array([], pa.list_(pa.string()))
        flat = tokens.flatten().dictionary_encode()
        self.words = flat.dictionary
        owner = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())
        pair, times = np.unique(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(len(tokens), 1) + owner, return_counts=True)
        self.owner, self.weight = pair % max(len(tokens), 1), query_weight(times.astype(float))
        self.first = np.searchsorted(pair, np.arange(len(self.words) + 1) * max(len(tokens), 1))


def _matcher(words: pa.Array) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
            code = pc.index_in(tokens.flatten(), value_set=words)
            known = code.is_valid().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(length)), length)[known]
            width = max(len(words), 1)
            pair, tf = np.unique(doc * width + code.drop_null().to_numpy().astype(np.int64), return_counts=True)
            first = np.searchsorted(pair, np.arange(len(length) + 1) * width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x.astype(np.int32))) for x in (pair % width, tf)]
            yield pa.record_batch([batch.column("did"), pa.array(length.astype(np.int32)), *lists], names=["did", "length", "term", "tf"])

    return run


def _scorer(sent, k: int, prepare: Callable[[int, int, np.ndarray], DocumentWeight]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, df, n, total = sent.value
        weigh, held = prepare(n, total, df), []
        queries = len(terms.ids)
        rows = max(1, min(ROWS, MATCHES // max(queries, 1)))
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                term = part.column("term")
                each = pc.list_value_length(term).to_numpy()
                code, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("term", "tf"))
                doc = np.repeat(np.arange(part.num_rows), each)
                value = weigh(tf, part.column("length").to_numpy()[doc], code)
                # Every match meets the queries that have its term.
                size = terms.first[code + 1] - terms.first[code]
                at = np.repeat(terms.first[code] - np.cumsum(size) + size, size) + np.arange(size.sum())
                cell = terms.owner[at] * part.num_rows + np.repeat(doc, size)
                shape = (queries, part.num_rows)
                scores = np.bincount(cell, weights=np.repeat(value, size) * terms.weight[at], minlength=queries * part.num_rows).reshape(shape)
                scores[np.bincount(cell, minlength=queries * part.num_rows).reshape(shape) == 0] = -np.inf
                held.append((np.broadcast_to(part.column("did").to_numpy(), shape), scores))
                if sum(s.shape[1] for _, s in held) > 4 * k + 2 * rows:
                    held = [_best(held, k)]
        if held:
            dids, scores = _best(held, k)
            keep = np.isfinite(scores.ravel())
            qids = np.repeat(terms.ids, scores.shape[1])[keep]
            yield pa.record_batch([pa.array(qids), pa.array(dids.ravel()[keep]), pa.array(scores.ravel()[keep])], names=["qid", "did", "score"])

    return run
