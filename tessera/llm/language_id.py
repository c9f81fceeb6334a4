"""Language identification by a byte convolutional network (operator 3).

Texts are read as ASCII-lower-cased UTF-8 bytes in windows of a fixed length, the last
one padded.  Filters of several widths slide over a window's bytes, each filter's
response is rectified and max-pooled over the window, and a softmax over the pooled
responses gives the window's language.  A text's prediction is the mean over all its
windows, weighted by their bytes.

Training is in numpy on the driver, on a bounded sample of labelled windows: up to
``TEXTS_PER_LANGUAGE`` texts of every label, ``SAMPLE_TEXTS`` in all where labels are so
many (but one of each label at least), those with the least hashes;
``WINDOWS_PER_TEXT`` windows spread evenly over each whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._store import discard, freeze, release, small_batches
from tessera.llm._words import LOWER, slices, string_buffers

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
TEXTS_PER_LANGUAGE = 600
SAMPLE_TEXTS = 20_000
WINDOWS_PER_TEXT = 6
EPOCHS = 6
UNKNOWN = "und"
#: Windows that are held at a time.
AT_ONCE = 128
#: Below this mean probability ``keep_known`` rejects a text.
LEAST_SCORE = 0.3

_LETTER = re.compile(r"[^\W\d_]")


def windows(offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where all windows of all texts start, whose text each is, and its bytes."""
    size = np.diff(offsets)
    each = -(-size // window)
    owner = np.repeat(np.arange(len(size)), each)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    start = offsets[owner] + nth * window
    return start, owner, np.minimum(offsets[owner + 1] - start, window)


def window_bytes(data: np.ndarray, start: np.ndarray, length: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The bytes of windows in lower case, padded with zeros."""
    places = np.arange(window)
    inside = places < length[:, None]
    return np.where(inside, LOWER[data[np.where(inside, start[:, None] + places, 0)]] if len(data) else 0, 0).astype(np.uint8)


@dataclass
class Network:
    """``tables[i][k]``: the responses of the filters of width ``WIDTHS[i]`` to each byte at their k-th place."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled responses of windows ``x``, and the place of each maximum."""
        every, places = [], []
        for table, bias in zip(self.tables, self.bias):
            n = x.shape[1] - len(table) + 1
            response = table[0][x[:, :n]]
            for k in range(1, len(table)):
                response += table[k][x[:, k : k + n]]
            place = response.argmax(axis=1)
            every.append(np.maximum(0, np.take_along_axis(response, place[:, None], 1)[:, 0] + bias))
            places.append(place)
        return np.concatenate(every, axis=1), places

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """The same responses, faster: byte pairs index tables of summed responses."""
        every = []
        pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        for table, bias, pairs in zip(self.tables, self.bias, self._pair_tables()):
            n = x.shape[1] - len(table) + 1
            response = np.take(pairs[0], pair[:, :n], axis=0)
            for k in range(2, len(table) - 1, 2):
                response += np.take(pairs[k // 2], pair[:, k : k + n], axis=0)
            if len(table) % 2:
                response += np.take(table[-1], x[:, len(table) - 1 : len(table) - 1 + n], axis=0)
            every.append(np.maximum(0, response.max(axis=1) + bias))
        return softmax(np.concatenate(every, axis=1) @ self.out + self.out_bias)

    def _pair_tables(self) -> list[list[np.ndarray]]:
        if not hasattr(self, "_pairs"):
            self._pairs = [[(t[k][:, None] + t[k + 1][None]).reshape(65536, -1) for k in range(0, len(t) - 1, 2)] for t in self.tables]
        return self._pairs

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_pairs"}


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 7, batch: int = 256, rate: float = 0.02) -> Network:
    """Trains on windows ``x`` with language numbers ``y`` by Adam; rarer languages weigh more."""
    rng = np.random.default_rng(seed)
    kinds = len(languages)
    tables = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), kinds)).astype(np.float32)
    net = Network(languages, tables, bias, out, np.zeros(kinds, np.float32))
    weight = 1 / np.maximum(1, np.bincount(y, minlength=kinds))
    weight = (weight * len(y) / kinds).astype(np.float32)
    params = [*tables, *bias, out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            xs, ys = x[own], y[own]
            hidden, places = net.pooled(xs)
            delta = softmax(hidden @ net.out + net.out_bias)
            delta[np.arange(len(own)), ys] -= 1
            delta *= weight[ys][:, None] / len(own)
            back = (delta @ net.out.T) * (hidden > 0)
            grads = []
            rows = np.arange(len(own))[:, None]
            for i, place in enumerate(places):
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                grad = np.zeros_like(tables[i])
                for k in range(WIDTHS[i]):
                    np.add.at(grad[k], (xs[rows, place + k], np.arange(FILTERS)[None]), part)
                grads.append(grad)
            grads += [back[:, i * FILTERS : (i + 1) * FILTERS].sum(0) for i in range(len(WIDTHS))]
            grads += [hidden.T @ delta, delta.sum(0)]
            step += 1
            pace = rate / (1 + epoch)
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def train(labelled: DataFrame, texts_per_language: int = TEXTS_PER_LANGUAGE, sample_texts: int = SAMPLE_TEXTS, epochs: int = EPOCHS) -> Network | None:
    """A network for all labels of ``labelled`` (text, lang); None where no row has both a text and a label.

    Equal rows count once.  Which rows are taken depends on hashes of their text and (where
    there is one) doc_id only, not on their order.
    """
    # With the id in the hash, copies of a text are not picked all together.
    own = ["doc_id", "text"] if "doc_id" in labelled.columns else ["text"]
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64(*own).alias("pick")).where("text is not null and lang is not null and length(text) > 0")
    counts = freeze(rows.groupBy("lang").agg(F.approx_count_distinct("pick", 0.02).alias("n")), "labels")
    n_labels = counts.count()
    if not n_labels:
        return None
    bound = max(1, min(texts_per_language, sample_texts // n_labels))
    # A share that leaves too few with no chance to speak of; the least hashes of these are taken.
    share = F.least(F.lit(1.0), (2 * bound + 40) / F.col("n"))
    picked = rows.join(counts, "lang").where((F.pmod("pick", F.lit(1 << 30)) + 0.0) / (1 << 30) < share)
    least = Window.partitionBy("lang").orderBy(F.pmod("pick", F.lit(1 << 30)), "pick")
    picked = picked.groupBy("lang", "pick").agg(F.min("text").alias("text")).withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= bound).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, offsets = string_buffers(part.column("text"))
                start, owner, length = windows(offsets)
                keep = []
                for d in range(part.num_rows):
                    lo, hi = np.searchsorted(owner, [d, d + 1])
                    keep += np.unique(np.linspace(lo, hi - 1, WINDOWS_PER_TEXT).astype(int)).tolist()
                x = window_bytes(data, start[keep], length[keep])
                yield pa.record_batch([part.column("lang").take(pa.array(owner[keep])), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "bytes"])

    sample = picked.mapInArrow(cut, "lang string, bytes binary").toArrow()
    discard(labelled.sparkSession, counts.frozen)
    sample = sample.sort_by([("lang", "ascending"), ("bytes", "ascending")])
    coded = sample.column("lang").combine_chunks().dictionary_encode()
    x = np.frombuffer(b"".join(b.as_py() for b in sample.column("bytes")), np.uint8).reshape(-1, WINDOW)
    return fit(x, coded.indices.to_numpy(), coded.dictionary.to_pylist(), epochs)


def predict_texts(net: Network | None, text: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language of each text, and its mean probability over all windows."""
    lang, score = [UNKNOWN] * len(text), np.zeros(len(text))
    if net is None:
        return lang, score
    coded = pc.dictionary_encode(pc.fill_null(text, ""))  # copies are judged once
    data, offsets = string_buffers(coded.dictionary)
    start, owner, length = windows(offsets)
    total = np.zeros((len(coded.dictionary), len(net.languages)))
    for lo in range(0, len(start), AT_ONCE):
        own = slice(lo, lo + AT_ONCE)
        np.add.at(total, owner[own], net.probabilities(window_bytes(data, start[own], length[own])) * length[own, None])
    total /= np.maximum(1, np.diff(offsets))[:, None]
    best = total.argmax(axis=1)
    letters = np.array([bool(_LETTER.search(t)) for t in coded.dictionary.to_pylist()], bool)
    for row, d in enumerate(coded.indices.to_pylist()):
        if letters[d]:
            lang[row], score[row] = net.languages[best[d]], min(1.0, float(total[d, best[d]]))
    return lang, score


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` (text and any other columns) with ``lang_pred`` and ``score``.

    A null text, and one without a letter, is ``und`` with score 0; so is every text where
    there is no network.  Columns of these names in ``docs`` are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast(net)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                lang, score = predict_texts(sent.value, part.column("text"))
                yield pa.record_batch([*part.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*columns, "lang_pred", "score"])
            release()

    schema = docs.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    return docs.mapInArrow(run, schema)


def held_out(doc_id) -> F.Column:
    """Whether a document is in the fold that nothing is learned from; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of ``docs`` (doc_id, text, lang), learned from the other folds."""
    split = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "lang", held_out("doc_id").alias("held_out"))
    net = train(split.where("not held_out"))
    return identify(split.select("doc_id", "text", "held_out"), net).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, net: Network | None, least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without texts of no letter (null and empty ones too), and without those in which no language reaches ``least_score``.

    Columns stay as they were, whatever their names; repeated rows are judged each; without
    a network no language is known and nothing is kept; no rows give no rows.
    """
    columns = docs.columns
    wrapped = docs.select(F.struct(*columns).alias("kept"), F.col("text").cast("string").alias("text"))
    return identify(wrapped, net).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("kept.*")
