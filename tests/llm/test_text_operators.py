"""Substring dedup (5), Jaccard join (7), decontamination (8): against brute force."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import decontamination as D
from tessera.llm import jaccard_join as J
from tessera.llm import substring_dedup as S
from tessera.llm._words import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@given(st.lists(st.text(alphabet="ab \t\né漢", max_size=40), max_size=8))
@settings(max_examples=80, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    w = words(pa.array(texts, pa.string()))
    got = [[w.word_bytes(i).decode() for i in range(w.first[d], w.first[d + 1])] for d in range(w.n_docs)]
    assert got == [WORD.findall(t) for t in texts]
    by_word = defaultdict(set)
    for h, t in zip(w.hash.tolist(), itertools.chain(*got)):
        by_word[t].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len(set.union(set(), *by_word.values())) == len(by_word)


def test_a_very_long_word():
    a, b = "x" * 600_000, "x" * 599_999 + "y"
    h = words(pa.array([a, b, a], pa.string())).hash
    assert h[0] == h[2] != h[1]


def test_words_of_a_very_long_text():
    """20 MB in one text: places and hashes take memory, flags hardly any; words across stretches are whole."""
    import tracemalloc

    text = pa.array([None, "word " * 4_000_000, "x" * (9 << 20) + " End"])
    tracemalloc.start()
    w = words(text, lower=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert w.counts.tolist() == [0, 4_000_000, 2] and len(np.unique(w.hash)) == 3
    assert w.end[-2] - w.start[-2] == 9 << 20 and peak < 12 * 20_000_000


def expected_repeats(docs, n=13):
    first = {}
    for d, t in docs:
        w = WORD.findall(t or "")
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            key = d if d is not None else 1 << 62
            first[k] = min(first.get(k, key), key)
    out = Counter()
    for d, t in docs:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < (d if d is not None else 1 << 62):
                gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("name", ["odd_docs", "copied_docs", "no_docs"])
@pytest.mark.parametrize("window", [5, 13])
def test_repeats(request, name, window):
    docs = request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.repeats(docs, window).collect())
    assert got == expected_repeats(rows, window)


def test_dedup_keeps_columns_and_clean_texts(copied_docs):
    out = S.dedup_substrings(copied_docs)
    assert out.columns == copied_docs.columns
    before = {r["doc_id"]: r["text"] for r in copied_docs.collect()}
    spans = {r["doc_id"]: r for r in S.repeats(copied_docs).collect()}
    after = {r["doc_id"]: r for r in out.collect()}
    for d, text in before.items():
        kept = hashlib.sha256(" ".join(WORD.findall(after[d]["text"])).encode()).hexdigest() if d in after else hashlib.sha256(b"").hexdigest()
        assert kept == spans[d]["kept_sha256"]
        if spans[d]["n_removed"] == 0:
            assert after[d]["text"] == text
        elif d in after:
            assert after[d]["n_chars"] == len(after[d]["text"])


def shingles(text, n=5):
    w = WORD.findall(text or "")
    return frozenset([" ".join(w)] if 0 < len(w) < n else [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)])


def expected_groups(docs, threshold=0.8):
    big = 1 << 62
    sets = [(big if d is None else d, i, shingles(t)) for i, (d, t) in enumerate(docs)]
    rep = {}
    for d, i, s in sorted(sets, key=lambda x: x[:2]):
        if s:
            rep.setdefault(s, (d, i))
    keys = list(rep)
    parent, links = {k: k for k in keys}, Counter()

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(keys, 2):
        if len(a & b) >= threshold * len(a | b) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(a), root(b)), key=lambda k: rep[k])
            parent[y] = x
    copies = Counter(s for _, _, s in sets)
    least = {}
    for k in keys:
        least[root(k)] = min(least.get(root(k), rep[k]), rep[k])
    show = lambda d: None if d == big else d
    return Counter((show(d), show(least[root(s)][0]) if s else show(d), show(rep[s][0]) if s else show(d), copies[s] if s else 1, links[s]) for d, _, s in sets)


@pytest.mark.parametrize("name", ["odd_docs", "copied_docs", "no_docs"])
def test_near_duplicates(request, name):
    docs = request.getfixturevalue(name)
    got = Counter((r["doc_id"], r["class_id"], r["copy_of"], r["n_copies"], r["n_links"]) for r in J.near_duplicates(docs).collect())
    assert got == expected_groups([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_large_cluster_in_tiles(spark, monkeypatch):
    """A cluster of near copies over many tiles loses no link."""
    monkeypatch.setattr(J, "TILE_ROWS", 7)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:i], f"c{i}", *base[i + 1 :]])) for i in range(40)]
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = expected_groups(rows)
    assert Counter((r["doc_id"], r["class_id"], r["copy_of"], r["n_copies"], r["n_links"]) for r in got) == want
    assert {r["class_id"] for r in got} == {0}


def test_more_tiles_than_rows(spark, monkeypatch):
    """Long texts give a cluster more tiles than rows; an empty tile counts no link again."""
    monkeypatch.setattr(J, "TILE_SHINGLES", 20)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:i], f"c{i}", *base[i + 1 :]])) for i in range(6)]
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["n_links"] for r in got} == {5}
    assert Counter((r["doc_id"], r["class_id"], r["copy_of"], r["n_copies"], r["n_links"]) for r in got) == expected_groups(rows)


def test_cut_cluster_of_many_sizes(spark, monkeypatch):
    """Chains of texts that shrink step by step: links within and across size classes, in any tiles."""
    monkeypatch.setattr(J, "TILE_ROWS", 4)
    base = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(base[: 90 - i])) for i in range(70)] + [(100 + i, " ".join(base[i:])) for i in range(1, 40)]
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["class_id"], r["copy_of"], r["n_copies"], r["n_links"]) for r in got) == expected_groups(rows)


def test_keep_one(copied_docs):
    kept = J.keep_one(copied_docs)
    assert kept.columns == copied_docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted({r["class_id"] for r in J.near_duplicates(copied_docs).collect()})


def test_banding_reaches_the_recall():
    bands, rows = J.bands_and_rows(0.8, 0.9999, 128)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128
    rng = np.random.default_rng(1)
    missed, trials = 0, 300
    for _ in range(trials):
        shared, a, b = (rng.integers(0, 1 << 48, n, dtype=np.uint64) for n in (88, 11, 11))
        both = np.concatenate([np.sort(np.concatenate([shared, a])), np.sort(np.concatenate([shared, b]))])
        h = J.band_hashes(both, np.array([0, 99, 198]), bands, rows)
        missed += not (h[0] == h[1]).any()
    assert missed <= 2


@given(st.lists(st.integers(0, 5), min_size=1, max_size=80))
@settings(max_examples=100, deadline=None)
def test_suffix_array(values):
    s = np.array(values)
    assert D.suffix_array(s).tolist() == sorted(range(len(values)), key=lambda i: values[i:])


@given(st.lists(st.integers(1, 6), min_size=1, max_size=120), st.lists(st.lists(st.integers(1, 6), min_size=2, max_size=2), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_index_finds_every_occurrence(shard, windows):
    vocabulary = np.array(sorted({x for w in windows for x in w}), np.uint64)
    rows = np.searchsorted(vocabulary, np.array(windows, np.uint64))
    window, at = D.FMIndex(np.array(shard, np.uint64), vocabulary, 3).search(rows.ravel(), 2 * np.arange(len(rows)), 2)
    want = sorted((k, i) for k, w in enumerate(windows) for i in range(len(shard) - 1) if shard[i : i + 2] == w)
    assert sorted(zip(window.tolist(), at.tolist())) == want


def expected_hits(docs, items, n=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    windows = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall((t or "").translate(low))
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k and item is not None else 0):
            windows[tuple(w[i : i + k])].add(item)
    sizes = {len(k) for k in windows}
    out = Counter()
    for d, t in docs:
        w = ALNUM.findall((t or "").translate(low))
        hit, found = [False] * len(w), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    found |= windows[tuple(w[i : i + k])]
                    hit[i : i + k] = [True] * k
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[d, len(w), sum(hit), len(found), digest, any(hit)] += 1
    return out


@pytest.mark.parametrize("name", ["odd_docs", "copied_docs", "no_docs"])
@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_contamination(request, spark, name, block_bytes):
    docs = request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    texts = [t for _, t in rows if t and len(t) > 60][:4]
    items = [(i, " ".join(WORD.findall(t)[3:18]).upper()) for i, t in enumerate(texts)] + [(50, None), (51, ""), (52, "same text"), (None, "one"), (0, "a second row of item"), (53, "ONE")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hit_spans", F.lit(1))
    got = D.contamination(docs, bench, block_bytes=block_bytes).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == expected_hits(rows, items)


def test_small_shards_find_hits_across_their_edges():
    text = pa.array(["a b c d e f g h i j k l", "x a b c y"])
    known = D.phrases(pa.array([1, 2, 2, 3]), pa.array(["c d e f g h i j k l", "a b c", "A b C", ""]))
    for shard in (1, 2, 3, 5, 100):
        w, hit, pairs = D.hits(text, known, shard)
        assert hit.tolist() == [True] * 12 + [False, True, True, True, False] and pairs.tolist() == [[0, 1], [0, 2], [1, 2]]


def test_windows_of_a_large_block_take_little_memory():
    import random
    import tracemalloc

    rng = random.Random(2)
    text = [" ".join(f"{rng.randrange(1 << 20):x}" for _ in range(40)) for _ in range(10_000)]
    tracemalloc.start()
    known = D.phrases(pa.array(range(len(text))), pa.array(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * sum(map(len, text)) and len(known.by_length[0][1]) == 31 * len(text)


@pytest.mark.parametrize("name", ["odd_docs", "no_docs"])
@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontaminate_odd_texts(request, spark, name, block_bytes):
    docs = request.getfixturevalue(name).withColumn("_hits", F.lit(1))
    bench = spark.createDataFrame([(1, "naïve café Ünïcode 漢字 текст"), (None, "a b c d e f g h i j"), (2, None), (3, "one"), (3, "x" * 5000)], "item_id long, text string")
    out = D.decontaminate(docs, bench, block_bytes=block_bytes)
    assert out.columns == docs.columns
    gone = ("one", "naïve café Ünïcode 漢字 текст", "x" * 5000)
    want = [r for r in docs.collect() if r["text"] not in gone]
    assert sorted(map(str, (r for r in out.collect() if r["doc_id"] is not None))) == sorted(map(str, (r for r in want if r["doc_id"] is not None)))


@pytest.mark.parametrize("name", ["odd_docs", "no_docs"])
def test_dedup_and_keep_one_of_odd_texts(request, name):
    """Nulls, a null id, repeated rows, no rows, columns of any name: nothing but copies and repeats goes."""
    docs = request.getfixturevalue(name).withColumnRenamed("n", "low").withColumn("copy_of", F.lit("x"))
    cut, one = S.dedup_substrings(docs), J.keep_one(docs)
    assert cut.columns == one.columns == docs.columns
    rows = docs.collect()
    # A repeated row is no repeat of a smaller id; equal texts are near duplicates, texts without words are not.
    assert sorted(map(str, cut.collect())) == sorted(map(str, rows))
    wordless = [r for r in rows if not WORD.findall(r["text"] or "")]
    texts = {tuple(WORD.findall(r["text"])) for r in rows if WORD.findall(r["text"] or "")}
    assert one.count() == len(wordless) + len(texts)


def test_messages_are_no_more_than_keys():
    """However many buckets the corpus needs, a block sends no more messages than it has keys, in time of its keys."""
    from tessera.llm import _blocks as B

    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    for buckets in (1, 100, 100_000_000):
        found = B.bucket_ranges(keys, buckets)
        assert [lo for _, lo, _ in found] == [0, *(hi for _, _, hi in found[:-1])] and found[-1][2] == len(keys)
        assert all(int(keys[i]) >> 32 << 0 and (int(keys[i]) >> 32) * buckets >> 32 == b for b, lo, hi in found for i in (lo, hi - 1))
        assert len(found) <= min(buckets, len(keys))


def test_decontaminate(spark, copied_docs):
    text = next(r["text"] for r in copied_docs.orderBy("doc_id").collect() if len(r["text"].split()) > 60)
    bench = spark.createDataFrame([(1, " ".join(text.split()[20:40]))], "item_id long, text string")
    out = D.decontaminate(copied_docs.withColumn("hit_spans", F.lit("mine")), bench)
    assert out.columns == [*copied_docs.columns, "hit_spans"]
    after = {r["doc_id"]: r for r in out.collect()}
    for r in copied_docs.collect():
        if r["text"] == text:
            assert after[r["doc_id"]]["text"].split() == text.split()[:20] + text.split()[40:]
            assert after[r["doc_id"]]["n_chars"] == len(after[r["doc_id"]]["text"])
    assert D.contamination(out, bench).where("contaminated").count() == 0
    empty = D.decontaminate(copied_docs, spark.createDataFrame([], "item_id long, text string"))
    assert sorted(map(str, empty.collect())) == sorted(map(str, copied_docs.collect()))


def test_pipeline_stages_against_brute_force(spark):
    """Every stage on what its predecessor kept, by plain Python."""
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    stages = dict(C.STAGES)
    first = spark.read.parquet(f"{sf}/documents.parquet")
    known = stages["language_id"](spark, first, sf)
    assert rows(known) == {d: t for d, t in rows(first).items() if re.search(r"[^\W\d_]", t or "")}
    single = stages["near_duplicates"](spark, known, sf)
    groups = expected_groups(list(rows(known).items()))
    assert rows(single).keys() == {g[1] for g in groups}
    whole = stages["substring_dedup"](spark, single, sf)
    removed = {d: (n, digest) for d, _, n, digest in expected_repeats(list(rows(single).items()))}
    after = rows(whole)
    for d, text in rows(single).items():
        n, digest = removed[d]
        kept = WORD.findall(after.get(d) or "")
        assert hashlib.sha256(" ".join(kept).encode()).hexdigest() == digest and (n or after[d] == text)
    clean = stages["decontamination"](spark, whole, sf)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = {d: (n, k) for d, n, k, *_ in expected_hits(list(after.items()), items)}
    last = rows(clean)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, text in after.items():
        n, k = hits[d]
        assert len(ALNUM.findall((last.get(d) or "").translate(low))) == n - k and (k or last[d] == text)
    assert not [k for k in expected_hits(list(last.items()), items) if k[2]]
    packed = stages["packing"](spark, clean, sf).collect()
    assert {r["doc_id"] for r in packed} == last.keys()
    by_sequence = defaultdict(list)
    for r in packed:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(placed)])
        assert [o for o, _ in sorted(placed)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
