"""Token rows (1) and pattern packing (9)."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pattern_packing as P
from tessera.llm import token_rows as R
from tessera.llm.tokens import encoder


def ids_of(text):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_tokenizers(odd_docs):
    encode = encoder()
    for r in odd_docs.select("text").collect():
        assert encode(r["text"] or "").tolist() == ids_of(r["text"])


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=60, deadline=None)
def test_room_tree_is_best_fit(needs):
    tree, rooms = R.RoomTree(64), []
    for k, need in enumerate(needs):
        tree.add(need, k)
        rooms.append(need)
    for need in needs[::-1]:
        found = tree.take(need)
        fits = [r for r in rooms if r >= need]
        assert (found is None) == (not fits)
        if found:
            assert found[0] == min(fits)
            rooms.remove(found[0])


def test_token_rows_round_trip(odd_docs):
    rows = R.token_rows(odd_docs)
    for r in rows.collect():
        ids, places = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2")
        assert len(ids) == R.SEQ_LEN and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= R.SEQ_LEN
        for lo, hi in zip(r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert places[lo:hi].tolist() == list(range(hi - lo))
        assert (ids[r["n_tokens"] :] == R.END_ID).all()
    got = defaultdict(list)
    for r in R.unpack(rows).orderBy("doc_id", "start").collect():
        got[r["doc_id"]] += np.frombuffer(r["ids"], "<u2").tolist()
    want = defaultdict(list)
    for r in odd_docs.collect():
        want[r["doc_id"]] += [*ids_of(r["text"]), R.END_ID]
    assert Counter({k: len(v) for k, v in got.items()}) == Counter({k: len(v) for k, v in want.items()})
    assert all(got[k] == want[k] for k in want if k != 9)


def test_no_documents(no_docs):
    assert R.token_rows(no_docs).count() == 0
    assert P.pack(no_docs).count() == 0


def check_pieces(docs, pieces, seq_len):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= seq_len
    for r in docs:
        ids = [*ids_of(r["text"]), 0]
        if r["doc_id"] == 9:
            continue
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(by_doc[r["doc_id"]])):
            assert (piece, start) == (k, at) and (k == 0 or length == seq_len)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    return len(by_sequence)


@pytest.mark.parametrize("seq_len", [64, 2048])
def test_pattern_packing(odd_docs, seq_len):
    docs = odd_docs.collect()
    used = check_pieces(docs, P.pack(odd_docs, seq_len).collect(), seq_len)
    total = sum(len(ids_of(r["text"])) + 1 for r in docs)
    assert used <= -(-total // seq_len) + 2


@given(st.dictionaries(st.integers(1, 100), st.integers(1, 400), min_size=1, max_size=100))
@settings(max_examples=40, deadline=None)
def test_plan_covers_the_histogram(histogram):
    plan = P.plan(histogram, 100)
    placed = Counter()
    for lengths, n in plan:
        assert sum(lengths) <= 100 and n > 0
        for v in lengths:
            placed[v] += n
    assert placed == Counter(histogram)
    lower = max(-(-sum(k * v for k, v in histogram.items()) // 100), sum(v for k, v in histogram.items() if k > 50))
    assert sum(n for _, n in plan) <= 1.25 * lower + 2


@pytest.mark.parametrize("most", [300, 700, 2048])
def test_plan_is_never_worse_than_best_fit(most):
    """Few and many distinct lengths: no more sequences than best fit alone, and near the least that lengths allow."""
    rng = np.random.default_rng(most)
    histogram = Counter(rng.integers(1, most + 1, 60_000).tolist())
    count = lambda found: sum(n for _, n in found)
    used = count(P.plan(histogram))
    assert used <= count(P.best_fit_decreasing(histogram, P.SEQ_LEN))
    assert used <= -(-sum(k * v for k, v in histogram.items()) // P.SEQ_LEN) * 1.002 + 1


def test_all_exact_patterns():
    found = P.enumerate_patterns(np.array([1, 2, 3, 4, 5, 6, 10]), 10)
    want = {c for n in (1, 2, 3) for c in __import__("itertools").combinations_with_replacement((10, 6, 5, 4, 3, 2, 1), n) if sum(c) == 10}
    assert {tuple(r) for g in found for r in g.tolist()} == want and sum(map(len, found)) == len(want)


def test_written_token_rows(spark, odd_docs, tmp_path):
    R.write_token_rows(odd_docs, f"file://{tmp_path}/rows", seq_len=128)
    back = spark.read.parquet(f"file://{tmp_path}/rows")
    assert Counter(map(str, back.collect())) == Counter(map(str, R.token_rows(odd_docs, 128).collect()))
    assert R.unpack(back).agg({"start": "count"}).first()[0] == R.unpack(R.token_rows(odd_docs, 128)).count()


def test_groups_pack_like_best_fit_decreasing():
    """Groups with open rows between them need hardly more rows than one best fit of everything."""
    rng = np.random.default_rng(5)
    lengths = np.minimum(2048, rng.lognormal(5.5, 1.0, 30_000).astype(int) + 1)
    packer, rows = R.Packer(), 0
    for k, n in enumerate(lengths.tolist()):
        rows += len(packer.add(k, np.zeros(n, np.uint16)))
    rows += len(packer.finish())
    best = sum(n for _, n in P.best_fit_decreasing(Counter(lengths.tolist()), 2048))
    assert best <= rows <= 1.01 * best
