"""Language-model scoring by a hierarchical Pitman-Yor model (operator 6).

A word is drawn in the restaurant of the word before it; all context restaurants share
the parent restaurant of single words, whose base is uniform over the known words and
one unknown.  Customers of one dish in one restaurant are a cell; their number of tables
is what the parent sees.  A Gibbs sweep draws every cell's number of tables from its
conditional given the parent and the restaurant's tables (sweeps run over all cells at
once, with the restaurants' totals of the sweep before), then the parent's.  The first
sweeps are left out; the predictive probabilities of the others are averaged.

A cell of c customers has t tables with a chance in proportion to S(c, t) w**t, where S
is the generalised Stirling number of the discount and w what a new table weighs.  S
comes from its recurrence for small cells, and for larger ones from its alternating sum
or, where that loses digits, a saddle point with its next term: logarithms of S within
0.03, mostly within 0.007.

Counts are made over all training texts.  Each block of documents sends its distinct
words and word pairs to hash buckets and gets back their corpus counts; one block owns
each pair.  Draws are functions of the pair's hash and the sweep, so a block that holds
a pair can repeat its draw, and only sums over owned pairs travel: tables by dish and by
context, to the buckets of single words.  A word or pair that makes up a third of the
corpus is one entry a block.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _blocks as B
from tessera.llm._store import freeze
from tessera.llm._words import mix, words

#: Gibbs sweeps, and how many of them come before those that are averaged.
SWEEPS = 4
BURN_IN = 1
#: Concentrations of the context restaurants and of their parent; discounts are set from the counts of ones and twos.
STRENGTH = 0.5
PARENT_STRENGTH = 1.0
#: Stirling numbers of cells of up to so many customers come from their recurrence.
EXACT = 512
#: Larger cells of up to so many tables (and an eighth of their customers) read Stirling numbers from a grid of customers, between whose lines they are interpolated.
NEAR = 512
STEP = 0.05
#: Table numbers that are weighed for other cells; where its law is wider, they stand for equal stretches of it.
POINTS = 64
BLOCK_BYTES = 8 << 20

#: Hashes that stand for the start (a context) and the end (a token) of every text.
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_PAIR = np.uint64(0x9FB21C651E98DF25)


@lru_cache(maxsize=8)
def _stirling(discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers, for up to ``EXACT`` customers at each number of tables."""
    s = np.full((EXACT + 1, NEAR + 1), -np.inf)
    s[1, 1] = 0
    for c in range(1, EXACT):
        stay = np.log(np.maximum(c - discount * np.arange(c + 1), 1e-300)) + s[c, : c + 1]
        s[c + 1, : c + 1] = stay
        s[c + 1, 1 : c + 2] = np.logaddexp(s[c + 1, 1 : c + 2], s[c, : c + 1])
    return s


@lru_cache(maxsize=8)
def _near_stirling(discount: float, doublings: int) -> np.ndarray:
    """The same for numbers of tables up to ``NEAR``, less what doesn't depend on them, at customers that rise by factors of exp(``STEP``) over so many doublings."""
    c = (EXACT + 1) * np.exp(STEP * np.arange(math.ceil(doublings * math.log(2) / STEP) + 2))
    t = np.broadcast_to(np.arange(1.0, NEAR + 1), (len(c), NEAR))
    s = np.full((len(c), NEAR + 1), -1e30)
    s[:, 1:] = np.where(t <= c[:, None], log_stirling(c, np.minimum(t, c[:, None]), discount), -1e30)
    return s


def _uniform(seed: np.ndarray, salt: int) -> np.ndarray:
    """Numbers over 0 and below 1 that a hash decides."""
    step = np.uint64(salt * 0xD6E8FEB86659FD93 % (1 << 64))
    return ((mix(seed + step) >> np.uint64(11)) + 0.5) / float(1 << 53)


def draw_tables(customers: np.ndarray, weight: np.ndarray, discount: float, seed: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of cells with ``customers``, where a new table weighs ``weight`` and an old one its customers less the discount."""
    tables = np.minimum(customers, 1).astype(np.int64)
    several = np.flatnonzero(customers > 1)
    c, w, u = customers[several], np.maximum(weight[several], 1e-300), _uniform(seed[several], sweep)
    # Tables are less spread than a Poisson number of mean w / discount, and one.
    mean = w / discount
    most = np.minimum(np.ceil(mean + 6 * np.sqrt(mean) + 8), 1 << 62).astype(np.int64)
    small = c <= EXACT
    far = ~small & ((most > NEAR) | (most > np.maximum(c, EXACT) // 8))
    if far.any():
        tables[several[far]] = _draw_large(c[far].astype(float), w[far], discount, u[far])
    # The row of the weights' table that a cell reads, and how much of the next one.
    # In steps of eight doublings, so that a worker makes few tables.
    exact, near = _stirling(discount), _near_stirling(discount, 8 * max(1, -(-(int(c.max(initial=1)).bit_length() - 9) // 8)))
    step = (np.log(np.maximum(c, EXACT + 1)) - math.log(EXACT + 1)) / STEP
    row = np.where(small, c, EXACT + 1 + np.minimum(step.astype(np.int64), len(near) - 2))
    share = np.where(small, 0.0, step - (row - EXACT - 1))
    rows = np.concatenate([exact, near])
    most, log_w = np.where(small, np.minimum(c, most), most), np.log(w)
    order = np.flatnonzero(~far)
    order = order[np.argsort(most[order], kind="stable")]
    for own in np.array_split(order, -(-len(order) // 4096)) if len(order) else []:
        t = np.arange(1, int(most[own[-1]]) + 1)
        # Of the recurrence's cells, numbers of tables beyond the customers weigh nothing.
        own_small, own_near = own[small[own]], own[~small[own]]
        p = t * log_w[own_small, None] + rows[row[own_small], 1 : len(t) + 1]
        tables[several[own_small]] = _drawn(p, u[own_small])
        at = row[own_near]
        p = t * log_w[own_near, None] + rows[at, 1 : len(t) + 1] * (1 - share[own_near, None]) + rows[at + 1, 1 : len(t) + 1] * share[own_near, None]
        tables[several[own_near]] = _drawn(p, u[own_near])
    return tables


def _drawn(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Numbers from 1, drawn by logarithms of weights."""
    p = np.exp(p - p.max(axis=1, keepdims=True)) if len(p) else p
    np.cumsum(p, axis=1, out=p)
    return 1 + (u[:, None] * p[:, -1:] > p).sum(axis=1)


def _draw_large(c: np.ndarray, w: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """Tables of cells beyond the recurrence, from the weights of up to ``POINTS`` table numbers around the likely ones."""
    middle, spread = _likely_tables(c, w, d)
    half = 6 * spread + 7
    low = np.maximum(1, np.floor(middle + 1 - half))
    stride = np.maximum(1, np.ceil((np.minimum(c, np.ceil(middle + 1 + half)) - low + 1) / POINTS))
    number = np.ceil((np.minimum(c, np.ceil(middle + 1 + half)) - low + 1) / stride)
    out = np.zeros(len(c), np.int64)
    order = np.argsort(number, kind="stable")
    for own in np.array_split(order, -(-len(order) * POINTS >> 18)):
        k = np.arange(int(number[own].max()))
        step = stride[own, None]
        # The middle of each stretch of table numbers weighs for all of it.
        first = low[own, None] + k * step
        t = np.minimum(first + (step - 1) / 2, c[own, None])
        p = t * np.log(w[own, None]) + log_stirling(c[own], t, d)
        p = np.where((k < number[own, None]) & (first <= c[own, None]), p, -np.inf)
        p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
        goal = u[own, None] * p[:, -1:]
        at = np.minimum((goal > p).sum(axis=1), len(k) - 1)
        rows = np.arange(len(own))
        below = np.where(at > 0, p[rows, at - 1], 0.0)
        inside = (goal[:, 0] - below) / np.maximum(p[rows, at] - below, 1e-300)
        out[own] = np.clip(first[rows, at] + np.floor(inside * step[:, 0]), 1, c[own]).astype(np.int64)
    return out


def _likely_tables(c: np.ndarray, w: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """About the mean (less one) and the deviation of the number of tables: Poisson tables of random sizes, given the sum of their sizes."""
    goal = np.log(c / w)
    y = np.maximum(goal / (1 - d), 0.4 * np.exp(np.minimum(goal, 0)))
    for _ in range(7):
        y = np.clip(y - (np.log(-np.expm1(-y)) + (1 - d) * y - goal) / (1 / np.expm1(y) + 1 - d), 1e-9, 600.0)
    phi, mean, step, _, _ = _tilted(y, d)
    rate = w * phi
    square = np.expm1(y) * step / mean  # variance over squared mean of a table's customers
    return np.minimum(rate, c), np.sqrt(np.minimum(rate, c) * square / (1 + square))


def _tilted(y: np.ndarray, d: float) -> tuple[np.ndarray, ...]:
    """Of the law of a table's customers, tilted by 1 - exp(-y): its sum, mean, and the steps of the mean's logarithm (first to third)."""
    phi = -np.expm1(-d * y) / d
    mean = np.exp(np.log(-np.expm1(-y)) + (1 - d) * y - np.log(phi))
    near = y < 0.02
    z = np.maximum(y, 0.01)
    e, f = np.expm1(z), np.expm1(d * z)
    a, b = (e + 1) / e / e, d * d * (f + 1) / f / f
    step = np.where(near, (1 - d) / 2 + (1 - d**2) * y / 12 - (1 - d**4) * y**3 / 720, 1 / e + 1 - d - d / f)
    second = np.where(near, (1 - d**2) / 12 - (1 - d**4) * y**2 / 240, b - a)
    third = np.where(near, -(1 - d**4) * y / 120, a * (2 * (e + 1) / e - 1) + d * b * (1 - 2 * (f + 1) / f))
    return phi, mean, step, second, third


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function of numbers over 0, by Stirling's series seven steps on."""
    x = np.asarray(x, float)
    z = x + 7
    inverse = 1 / z
    back = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + inverse * (1 / 12 - inverse**2 * (1 / 360 - inverse**2 / 1260)) - np.log(back)


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers S(c, t), less that of Gamma(c - d); a row of ``t`` (real numbers from 1 to c) for each of ``c``."""
    # Where the alternating sum keeps enough digits: a bound on the logarithm of what its terms lose.
    most = 12.0 if d < 0.5 else 25.0
    inside = most ** (1 - d) * c**d
    few, many = np.flatnonzero(t.min(axis=1) <= inside), np.flatnonzero(t.max(axis=1) > inside)
    out = np.empty(t.shape)
    if len(many):
        out[many] = _saddle_point(c[many, None], t[many], d)
    if len(few):
        own = t[few] <= inside[few, None]
        out[few] = np.where(own, _alternating_sum(c[few], np.where(own, t[few], 1.0), d), out[few])
    return out


def _alternating_sum(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """By inclusion and exclusion: the sum over j of (-1)**j binomial(t, j) Gamma(c - dj) / Gamma(-dj), over d**t t!."""
    base, sums, choose = log_gamma(c - d), np.zeros(t.shape), np.ones(t.shape)
    for j in range(1, 600):
        choose = choose * ((t - j + 1) / j)
        # 1 / Gamma(-dj) is -sin(pi d j) Gamma(1 + dj) / pi.
        size = choose * np.exp(math.lgamma(1 + d * j) + log_gamma(np.maximum(c - d * j, 0.01)) - base)[:, None]
        sums += (-1) ** (j + 1) * math.sin(math.pi * d * j) / math.pi * size
        if j > 2 and (np.abs(size) <= 1e-9 * np.abs(sums)).all():
            break
    return np.log(np.maximum(sums, 1e-300)) - log_gamma(t + 1) - t * math.log(d)


def _saddle_point(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """S is c! / t! times the coefficient of z**c in the t-th power of (1 - (1 - z)**d) / d: Daniels' approximation of it, with the next term."""
    goal = np.log(c / t)
    y = np.clip(2 * goal / (1 - d), 1e-9, 600.0)
    for _ in range(9):
        phi, mean, step, _, _ = _tilted(y, d)
        y = np.clip(y - (np.log(mean) - goal) / step, 1e-9, 600.0)
    phi, mean, step, second, third = _tilted(y, d)
    e = np.expm1(y)
    r = (e + 1) / e + step + second / step
    r_step = -(e + 1) / e / e + second + (third * step - second**2) / step**2
    skew, tail = e * r * r / (mean * step), e * r * ((e + 1) / e + r + r_step / r) / (mean * step)
    more = np.clip((tail / 8 - 5 * skew / 24) / t, -0.5, 0.5)
    base = log_gamma(c - d)
    out = log_gamma(c + 1) - base - log_gamma(t + 1) + t * np.log(phi) - c * np.log(-np.expm1(-y)) - 0.5 * np.log(2 * math.pi * t * e * mean * step) + np.log1p(more)
    return np.where(t >= c, -base, out)


def tokenised(rows: pa.RecordBatch) -> pa.RecordBatch:
    """A block's rows as numbers of tokens (words and one end a text); its distinct words and its tokens are in the first row."""
    w = words(rows.column("text"), lower=True)
    size = w.counts + 1
    token = np.full(int(size.sum()), END)
    token[np.arange(len(w.hash)) + w.doc()] = w.hash
    every, number = np.unique(np.concatenate([token, np.array([START])]), return_inverse=True)
    blob = len(every).to_bytes(8, "little") + len(token).to_bytes(8, "little")
    columns = [B.squeeze_sorted(every), blob + B.squeeze(number[:-1].astype(np.uint32))]
    rest = [None] * (rows.num_rows - 1)
    return pa.record_batch(
        [rows.column("doc_id"), rows.column("held_out"), pa.array(size, pa.int64()), *(pa.array([c, *rest], pa.binary()) for c in columns)],
        names=["doc_id", "held_out", "n", "words", "tokens"],
    )


class _Tokens:
    """A block's tokens, its distinct words and pairs, from ``tokenised`` rows."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        self.size = rows.column("n").to_numpy()
        blob = rows.column("tokens")[0].as_py()
        n_words, n = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
        self.words = B.expand_sorted(rows.column("words")[0].as_py(), n_words, np.uint64)
        self.token = B.expand(blob[16:], n, np.uint32)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        held_out = rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        self.n_train, self.train = int((~held_out).sum()), ~held_out[self.doc]
        self.start = int(np.searchsorted(self.words, START))
        context = np.full(n, self.start, np.uint32)
        context[1:] = self.token[:-1]
        context[np.cumsum(self.size)[:-1]] = self.start
        pair = mix(mix(self.words ^ _PAIR)[self.token] + self.words[context])
        order = np.argsort(pair)
        pair = pair[order]
        lead = np.concatenate([[True], pair[1:] != pair[:-1]])
        self.pairs = pair[lead]
        self.pair = np.empty(n, np.uint32)
        self.pair[order] = np.cumsum(lead) - 1
        # The dish and the context of each pair.
        self.dish, self.place = self.token[order[lead]], context[order[lead]]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often training has each word, and each pair."""
        word_count = np.bincount(self.token[self.train], minlength=len(self.words))
        word_count[self.start] = self.n_train
        return word_count, np.bincount(self.pair[self.train], minlength=len(self.pairs))


def _pack(values: np.ndarray) -> bytes:
    """Corpus-wide counts, in 32 bits where all of them fit and else in 64; the first byte says which."""
    kind = np.dtype(np.uint64 if len(values) and values.max() >> 32 else np.uint32)
    return bytes([kind.itemsize]) + B.squeeze(values.astype(kind))


def _unpack(blob: bytes, n: int) -> np.ndarray:
    return B.expand(blob[1:], n, np.dtype(f"u{blob[0]}")).astype(np.int64)


def _gather(keys: np.ndarray, buckets: int, got: dict, offset: int) -> np.ndarray:
    """What the buckets have answered about each of ``keys``."""
    out = np.zeros(len(keys), np.int64)
    for bucket, lo, hi in B.bucket_ranges(keys, buckets):
        out[lo:hi] = _unpack(got[bucket + offset][1], hi - lo)
    return out


class _Model:
    """The steps, with the numbers that hold for the whole corpus."""

    def __init__(self, word_buckets: int, pair_buckets: int, totals: dict | None = None) -> None:
        self.word_buckets, self.pair_buckets = word_buckets, pair_buckets
        self.offset = word_buckets + pair_buckets
        self.totals = totals or {}
        self.parents: list[dict] = []

    # Step 1: counts.
    def ask(self, block: int, rows: pa.RecordBatch) -> Iterator[B.Message]:
        t = _Tokens(rows)
        word_count, pair_count = t.counts()
        for keys, counts, buckets, shift in ((t.words, word_count, self.word_buckets, 0), (t.pairs, pair_count, self.pair_buckets, self.word_buckets)):
            for bucket, lo, hi in B.bucket_ranges(keys, buckets):
                yield bucket + shift, block, hi - lo, B.squeeze_sorted(keys[lo:hi]), _pack(counts[lo:hi])

    def count(self, bucket: int, sent: list[B.Message]) -> Iterator[B.Message]:
        every, number, counts = _merged(sent)
        total = np.bincount(number, weights=counts, minlength=len(every)).astype(np.int64)
        pairs = bucket >= self.word_buckets
        value, at = total[number], 0
        if pairs:
            # The first block that has seen a pair in training owns it.
            seen = np.flatnonzero(counts > 0)
            owner = np.zeros(len(number), np.int64)
            owner[seen[np.unique(number[seen], return_index=True)[1]]] = 1
            value = value * 2 + owner
        own = total[every != START] if not pairs else total
        stats = {"n": int(own.sum()), "v": int((own > 0).sum()), "ones": int((own == 1).sum()), "twos": int((own == 2).sum())}
        yield bucket, -1, len(own), b"", json.dumps(stats).encode()
        for _, block, n, _, _ in sent:
            yield bucket, block, n, _pack(value[at : at + n]), b""
            at += n

    # What a block knows of its words and pairs before sweep ``sweep``.
    def _known(self, t: _Tokens, got: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pair = _gather(t.pairs, self.pair_buckets, got, self.word_buckets)
        return _gather(t.words, self.word_buckets, got, 0), pair >> 1, (pair & 1).astype(bool)

    def _parent(self, t: _Tokens, got: dict, sweep: int, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parent's probability of each word, and the tables of each context, after ``sweep`` sweeps (0: from plain counts)."""
        known = self.totals
        if sweep == 0:
            return (count + 1) / (known["n"] + known["v"] + 1), count ** max(known["discount"], 0.5)
        customers, tables, held = np.minimum(count, 1), np.minimum(count, 1), np.minimum(count, 1)
        often = np.flatnonzero(count > 1)
        values = np.zeros((3, len(often)), np.int64)
        at = 0
        for bucket, lo, hi in B.bucket_ranges(t.words[often], self.word_buckets):
            n, keys, _ = got[bucket + self.offset * sweep]
            values[:, at : at + hi - lo] = _unpack(keys, 3 * n).reshape(3, n)
            at += hi - lo
        for target, value in zip((customers, tables, held), values):
            target[often] = value
        d, whole = known["parent_discount"], self.parents[sweep - 1]
        rest = (PARENT_STRENGTH + d * whole["tables"]) / (known["v"] + 1)
        return (np.maximum(0, customers - d * tables) + rest) / (PARENT_STRENGTH + whole["customers"]), held

    def _draw(self, t: _Tokens, got: dict, sweep: int, count: np.ndarray, pair_count: np.ndarray, own: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Tables of each pair (or of ``own`` ones) in ``sweep`` (from 1), given what the sweep before has left."""
        p, held = self._parent(t, got, sweep - 1, count)
        weight = (STRENGTH + self.totals["discount"] * held[t.place[own]]) * p[t.dish[own]]
        return draw_tables(pair_count[own], weight, self.totals["discount"], t.pairs[own], sweep)

    # Steps of a sweep: blocks send tables by word, buckets seat them in the parent.
    def seat(self, sweep: int):
        def act(block: int, rows: pa.RecordBatch, got: dict) -> pa.RecordBatch:
            t = _Tokens(rows)
            count, pair_count, owned = self._known(t, got)
            own = np.flatnonzero(owned)
            tables = self._draw(t, got, sweep, count, pair_count, own)
            by_dish = np.bincount(t.dish[own], weights=tables, minlength=len(t.words)).astype(np.int64)
            by_context = np.bincount(t.place[own], weights=tables, minlength=len(t.words)).astype(np.int64)
            often = np.flatnonzero(count > 1)
            keys, by_dish, by_context = t.words[often], by_dish[often], by_context[often]
            out = []
            for bucket, lo, hi in B.bucket_ranges(keys, self.word_buckets):
                out.append((bucket, block, hi - lo, B.squeeze_sorted(keys[lo:hi]), _pack(np.concatenate([by_dish[lo:hi], by_context[lo:hi]]))))
            return B.message_batch(out)

        return act

    def seat_parent(self, sweep: int):
        rest = (PARENT_STRENGTH + self.totals["parent_discount"] * (self.parents[-1]["tables"] if self.parents else self.totals["v"])) / (self.totals["v"] + 1)

        def answer(bucket: int, sent: list[B.Message]) -> Iterator[B.Message]:
            every, number, both = _merged(sent, 2)
            customers, held = (np.bincount(number, weights=b, minlength=len(every)).astype(np.int64) for b in both)
            tables = draw_tables(customers, np.full(len(every), rest), self.totals["parent_discount"], every, sweep)
            yield bucket, -1, len(every), b"", json.dumps({"customers": int(customers.sum()), "tables": int(tables.sum())}).encode()
            at = 0
            for _, block, n, _, _ in sent:
                own = number[at : at + n]
                yield bucket, block, n, _pack(np.concatenate([customers[own], tables[own], held[own]])), b""
                at += n

        return answer

    # The last step.
    def score(self, block: int, rows: pa.RecordBatch, got: dict) -> pa.RecordBatch:
        t = _Tokens(rows)
        count, pair_count, _ = self._known(t, got)
        p = np.zeros(len(t.pairs))
        d = self.totals["discount"]
        for sweep in range(BURN_IN + 1, SWEEPS + 1):
            parent, held = self._parent(t, got, sweep, count)
            tables = self._draw(t, got, sweep, count, pair_count)
            customers = count[t.place]
            p += (np.maximum(0, pair_count - d * tables) + (STRENGTH + d * held[t.place]) * parent[t.dish]) / (STRENGTH + customers)
        n_docs = len(t.size)
        by_token = np.log10(p / (SWEEPS - BURN_IN))[t.pair]
        c = count[t.token]
        base = np.log10((c + 1) / (self.totals["n"] + self.totals["v"] + 1))
        sums = (np.bincount(t.doc, weights=x, minlength=n_docs) for x in (c > 0, base, by_token))
        known, base_score, score = sums
        return pa.record_batch(
            [rows.column("doc_id"), rows.column("held_out"), pa.array(t.size, pa.int64()), pa.array(known.astype(np.int64)), pa.array(np.full(n_docs, self.totals["n"], np.int64)), pa.array(base_score), pa.array(score), pa.array(10 ** (-score / t.size))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
        )


def _merged(sent: list[B.Message], arrays: int = 1) -> tuple:
    """All keys of a bucket, rising; the number of each sent key; and the values sent with them."""
    every, number = np.unique(np.concatenate([B.expand_sorted(k, n, np.uint64) for _, _, n, k, _ in sent]), return_inverse=True)
    values = np.concatenate([_unpack(m, arrays * n).reshape(arrays, n) for _, _, n, _, m in sent], axis=1)
    return every, number, values[0] if arrays == 1 else values


def _sums(answers: DataFrame, names: str, where: str = "true") -> dict[str, int]:
    """Sums of the numbers that buckets report, one report a bucket."""
    report = F.from_json(F.decode("more", "UTF-8"), ", ".join(f"{n} long" for n in names.split()))
    row = answers.where("block = -1").where(where).select(report.alias("r")).agg(*(F.coalesce(F.sum(f"r.{n}"), F.lit(0)).alias(n) for n in names.split())).first()
    return {n: int(row[n]) for n in names.split()}


def _discount(ones: int, twos: int) -> float:
    """The usual estimate, kept inside 0.1 and 0.9."""
    return min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5


def scores(docs: DataFrame) -> DataFrame:
    """The model's score of each row of ``docs`` (doc_id, text), learned from the rows outside the held-out fold.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both
    log10 of the text's probability, by single words and by the model) and perplexity (the
    inverse of the model's mean probability of a token).  A null or empty
    text is the end token alone; repeated rows count each; a null doc_id is in training;
    further columns are ignored; no rows give no rows, and where nothing is in training
    every token is unknown.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    blocks = B.write_blocks(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out.alias("held_out")), BLOCK_BYTES, rewrite=tokenised)
    model = _Model(B.n_buckets(blocks, 30.0), B.n_buckets(blocks, 9.0))
    answers = freeze(B.meet(B.ask(blocks, model.ask), model.count), "counts")
    single, pair = _sums(answers, "n v ones twos", f"bucket < {model.word_buckets}"), _sums(answers, "ones twos", f"bucket >= {model.word_buckets}")
    model.totals = {"n": single["n"], "v": single["v"], "discount": _discount(**pair), "parent_discount": _discount(single["ones"], single["twos"])}
    # A sweep's reports leave out words that occur once: one customer and one table each.
    for sweep in range(1, SWEEPS + 1):
        seated = freeze(B.meet(B.told(blocks, answers.where("block >= 0"), model.seat(sweep), B.MESSAGE), model.seat_parent(sweep)), f"sweep{sweep}")
        sums = _sums(seated, "customers tables")
        model.parents = [*model.parents, {k: v + single["ones"] for k, v in sums.items()}]
        answers = answers.where("block >= 0").unionByName(seated.where("block >= 0").withColumn("bucket", F.col("bucket") + model.offset * sweep))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return B.told(blocks, answers.where("block >= 0"), model.score, schema)
