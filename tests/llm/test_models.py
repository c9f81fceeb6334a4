"""Language ID (3), language-model scoring (6), quality rules (10), sharding (4), WARC (2), the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import label_sharding as L
from tessera.llm import language_id as I
from tessera.llm import pitman_yor as Y
from tessera.llm import quality_rules as Q
from tessera.llm import warc as A

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = I.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    row = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert row["right"] >= 0.98 and 0 <= row["lo"] and row["hi"] <= 1


def test_language_of_odd_texts(spark, odd_docs, no_docs):
    rows = I.predictions(odd_docs.withColumn("lang_pred", F.lit(1))).collect()
    text = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        if not re.search(r"[^\W\d_]", text[r["doc_id"]] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert I.predictions(no_docs).count() == 0
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in I.predictions(unlabelled).collect()} == {"und"}


def test_fast_and_plain_responses_agree():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (40, I.WINDOW)).astype(np.uint8)
    net = I.fit(x, rng.integers(0, 3, 40), ["a", "b", "c"], 1)
    hidden, _ = net.pooled(x)
    assert np.allclose(net.probabilities(x), I.softmax(hidden @ net.out + net.out_bias), atol=1e-5)


def test_windows_cover_whole_texts():
    data = np.arange(700, dtype=np.int64).astype(np.uint8) | 0x80
    start, owner, length = I.windows(np.array([0, 0, 600, 700]))
    x = I.window_bytes(data, start, length)
    assert owner.tolist() == [1, 1, 1, 2] and length.tolist() == [256, 256, 88, 100] and not x[2, 88:].any()
    assert np.concatenate([r[:n] for r, n in zip(x, length)]).tolist() == data.tolist()


def test_all_labels_are_learned_in_any_layout(spark):
    """200 labels, a repeated row among them: each is learned, and the order of rows doesn't matter."""
    rows = [(k, f"{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{k % 200} " * 40, f"l{k % 200:03}") for k in range(800)] + [(5, "hot row", "l005")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = I.train(docs.repartition(3), epochs=1), I.train(docs.orderBy(F.desc("doc_id")).repartition(7), epochs=1)
    assert one.languages == [f"l{k:03}" for k in range(200)]
    assert np.array_equal(one.out, two.out) and all(np.array_equal(a, b) for a, b in zip(one.tables, two.tables))


def test_a_very_long_text_in_little_memory():
    import tracemalloc

    import pyarrow as pa

    net = I.fit(np.zeros((4, I.WINDOW), np.uint8), np.array([0, 1, 0, 1]), ["a", "b"], 1)
    text = pa.array(["word " * 4_000_000])
    net.probabilities(np.zeros((2, I.WINDOW), np.uint8))
    tracemalloc.start()
    I.predict_texts(net, text)
    assert tracemalloc.get_traced_memory()[1] < 4 * 20_000_000


@pytest.mark.parametrize("name", ["odd_docs", "no_docs"])
def test_keep_known(request, spark, name):
    docs = request.getfixturevalue(name)
    net = I.train(spark.read.parquet(f"{SF}/documents.parquet"))
    clashing = docs.withColumn("lang_pred", F.lit(1)).withColumn("kept", F.lit(2))
    kept = I.keep_known(clashing, net)
    assert kept.columns == clashing.columns
    assert not {0, 1, 2, 4} & {r["doc_id"] for r in kept.collect()}
    assert I.keep_known(docs, None).count() == 0


def base_scores(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(d, [*WORD.findall((t or "").translate(low)), None], d is not None and zlib.crc32(str(d).encode()) % 7 == 2) for d, t in docs]
    c = Counter(w for _, ws, h in rows if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return rows, c, n, v


@pytest.mark.parametrize("name", ["odd_docs", "copied_docs"])
def test_base_scores(request, name):
    docs = request.getfixturevalue(name)
    rows, c, n, v = base_scores([(r["doc_id"], r["text"]) for r in docs.collect()])
    want = Counter((d, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for d, ws, h in rows)
    got = Y.scores(docs).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_probabilities_stay_within_one(spark):
    """One-word texts of all known words, an unknown one and the empty text: different outcomes, at most one in sum."""
    train = [(i, "a b a c a b d") for i in range(12) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(12, 400) if zlib.crc32(str(i).encode()) % 7 == 2][:6]
    probes = list(zip(held, ["a", "b", "c", "d", "new", ""]))
    got = {r["doc_id"]: r["score"] for r in Y.scores(spark.createDataFrame(train + probes, "doc_id long, text string")).collect()}
    after = {t: 10 ** got[d] for d, t in probes}
    assert 0 < sum(after.values()) <= 1 + 1e-9


def test_model_beats_single_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = Y.scores(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"] * 0.88


def sequential_gibbs(train, probes, discount, parent_discount, sweeps=60, burn_in=20):
    """Log10 probabilities of texts by the textbook sampler: one customer leaves and sits down again at a time."""
    import random

    rng = random.Random(1)
    words = sorted({w for text in train for w in text})
    cells, dishes, base = {}, {w: [] for w in words}, 1 / (len(words) + 1)
    customers, tables, held = Counter(), Counter(), Counter()

    def parent(w):
        own, n, t = dishes.get(w, ()), sum(map(len, dishes.values())), 0
        n, t = sum(sum(x) for x in dishes.values()), n
        return (max(0, sum(own) - parent_discount * len(own)) + (Y.PARENT_STRENGTH + parent_discount * t) * base) / (Y.PARENT_STRENGTH + n)

    def seat(own, weight, d):
        x = rng.random() * (sum(own) - d * len(own) + weight)
        for k, n in enumerate(own):
            x -= n - d
            if x < 0:
                own[k] += 1
                return False
        own.append(1)
        return True

    def leave(own):
        x = rng.random() * sum(own)
        for k, n in enumerate(own):
            x -= n
            if x < 0:
                own[k] -= 1
                if not own[k]:
                    del own[k]
                    return True
                return False

    def sit(u, w):
        customers[u] += 1
        if seat(cells.setdefault((u, w), []), (Y.STRENGTH + discount * held[u]) * parent(w), discount):
            held[u] += 1
            seat(dishes[w], (Y.PARENT_STRENGTH + parent_discount * sum(map(len, dishes.values()))) * base, parent_discount)

    pairs = [(u, w) for text in train for u, w in zip([None, *text], text)]
    for u, w in pairs:
        sit(u, w)
    sums = Counter()
    for sweep in range(sweeps):
        rng.shuffle(pairs)
        for u, w in pairs:
            customers[u] -= 1
            if leave(cells[u, w]):
                held[u] -= 1
                leave(dishes[w])
            sit(u, w)
        if sweep >= burn_in:
            for u, w in {(u, w) for text in probes for u, w in zip([None, *text], text)}:
                own = cells.get((u, w), ())
                sums[u, w] += (max(0, sum(own) - discount * len(own)) + (Y.STRENGTH + discount * held[u]) * parent(w)) / (Y.STRENGTH + customers[u])
    return [sum(math.log10(sums[u, w] / (sweeps - burn_in)) for u, w in zip([None, *text], text)) for text in probes]


def test_scores_are_those_of_a_sequential_sampler(spark):
    """Every text's score is near that of the sampler that moves one customer at a time."""
    import random

    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.9))}" for _ in range(60)]
    docs = [(i, " ".join(rng.choice(vocabulary[k % 7 :: 3]) for k in range(rng.randrange(3, 14)))) for i in range(90)]
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    tokens = {i: [*t.split(), ""] for i, t in docs}
    train = [tokens[i] for i, _ in docs if i not in held]
    ones = lambda c: [sum(v == k for v in c.values()) for k in (1, 2)]
    pairs = Counter((u, w) for t in train for u, w in zip([None, *t], t))
    want = sequential_gibbs(train, [tokens[i] for i, _ in docs], Y._discount(*ones(pairs)), Y._discount(*ones(Counter(w for t in train for w in t))))
    got = {r["doc_id"]: r for r in Y.scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    each = [abs(got[i]["score"] - x) / len(tokens[i]) for (i, _), x in zip(docs, want)]
    assert max(each) < 0.12 and abs(sum(got[i]["score"] for i, _ in docs) / sum(want) - 1) < 0.02
    assert all(math.isclose(r["perplexity"], 10 ** (-r["score"] / r["n_tokens"])) for r in got.values())


def test_nothing_to_score(no_docs):
    assert Y.scores(no_docs).count() == 0


def test_stirling_draws_follow_the_weights():
    d, a = 0.6, 0.8
    seeds = np.arange(1, 40_001, dtype=np.uint64)
    t = Y.draw_tables(np.full(len(seeds), 4), np.full(len(seeds), a), d, seeds, 1)
    # All seatings of four customers: tables' products of (1 - d)(2 - d)..., times a for each table.
    s = {1: (1 - d) * (2 - d) * (3 - d), 2: 4 * (1 - d) * (2 - d) + 3 * (1 - d) ** 2, 3: 6 * (1 - d), 4: 1.0}
    w = np.array([s[k] * a**k for k in (1, 2, 3, 4)])
    assert np.abs(np.bincount(t, minlength=5)[1:] / len(seeds) - w / w.sum()).max() < 0.01


@pytest.mark.parametrize("customers", [200, 600, 10_000])
@pytest.mark.parametrize("discount, weight", [(0.2, 0.5), (0.7, 4.0), (0.9, 300.0)])
def test_large_cells_follow_the_weights(customers, discount, weight):
    """Draws against the law from the recurrence of the generalised Stirling numbers."""
    s = np.full(customers + 1, -np.inf)
    s[1], k = 0, np.arange(customers + 1)
    for c in range(1, customers):
        stay = np.where(k <= c, np.log(np.maximum(c - discount * k, 1e-300)), -np.inf) + s
        s = np.logaddexp(stay, np.concatenate([[-np.inf], s[:-1]]))
    p = s[1:] + k[1:] * math.log(weight)
    p = np.cumsum(np.exp(p - p.max()))
    seeds = np.arange(1, 20_001, dtype=np.uint64)
    t = Y.draw_tables(np.full(len(seeds), customers), np.full(len(seeds), weight), discount, seeds, 1)
    assert np.abs(np.cumsum(np.bincount(t, minlength=customers + 1)[1:]) / len(seeds) - p / p[-1]).max() < 0.015


def test_huge_cells_have_tables_in_bounds():
    c = np.array([1, 49, 1000, 10**6, 10**12])
    t = Y.draw_tables(c, np.full(5, 0.5), 0.8, np.arange(5, dtype=np.uint64), 1)
    assert t[0] == 1 and (t >= 1).all() and (t <= c).all()


def expected_statistics(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = [False] * len(w)
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            hit[i : i + 5] = [True] * 5
    n = len(w)
    return n, sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), sum(hit), n < 10 or 100 * sum(hit) > 20 * n


@pytest.mark.parametrize("name", ["odd_docs", "copied_docs", "no_docs"])
def test_base_rules(request, spark, name):
    docs = request.getfixturevalue(name)
    twice = docs.unionByName(docs.where("length(text) > 100").withColumn("text", F.concat_ws("\n", "text", "text", F.lit(" a | b"))))
    labels = spark.createDataFrame([(0, None), (None, 1), (7, 0), (7, 1), (8, 1), (999, 0)], "doc_id long, quality int")
    got = Q.judge(twice, labels).collect()
    want = Counter((r["doc_id"], *expected_statistics(r["text"])) for r in twice.collect())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_learned_list(spark):
    """Texts with symbols, and long words with many capitals, are labelled bad: the list finds both, and keeps the rest."""
    import random

    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        w = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 8))) for _ in range(60)]
        bad = i % 5 == 0
        if i % 10 == 0:
            w = [x + "#" if k % 3 == 0 else x for k, x in enumerate(w)]
        elif bad:
            w = [x.upper() for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad)))
    got = Q.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert {r["doc_id"] for r in got.where("kept").collect()} == {i for i in range(900) if i % 5}


def test_statistics_can_be_built_on(spark):
    """Filters and joins on statistics don't evaluate them anew."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("words", F.lit("mine"))
    stats = Q.statistics(docs)
    twice = stats.where(~Q.base_failed()).join(stats.select("doc_id", F.col("repeat_share").alias("again")), "doc_id")
    assert twice.where("again != repeat_share").count() == 0
    assert Q.learn(stats.limit(0).withColumn("bad", F.lit(1))) == Q.learn(stats.withColumn("bad", F.lit(None).cast("int"))) == []


@pytest.mark.parametrize("name", ["odd_docs", "copied_docs", "no_docs"])
@pytest.mark.parametrize("shards", [1, 16])
def test_sharding_laws(request, name, shards):
    docs = request.getfixturevalue(name)
    rows = L.shard_documents(docs, shards).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    by_shard = {}
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(by_shard.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_sharding_keeps_groups_together(copied_docs):
    sharded = L.shard_documents(copied_docs, 4)
    r = L.cut_links(sharded).first()
    # A third of all rows is one text: it fills one of four shards and the rest of it must lie elsewhere.
    assert r["cut"] <= 0.45 * r["links"]


PAGES = [(1, "http://a", "hello"), (2, "http://b", "hello"), (3, "http://c", None), (4, None, ""), (None, "x", "hello"), (5, "u", "é" * 100_000), (2, "dup", "hello")]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha", F.lit(1)).withColumn("first", F.lit("x"))
    rows = A.archived(pages).collect()
    b32 = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = Counter()
    for p, _, t in PAGES:
        same = [q for q, _, x in PAGES if (x or "") == (t or "") and q is not None]
        last = max(same)
        want[p, len((t or "").encode()), b32(t), "response" if p == last else "revisit", None if p == last else last] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) == want
    assert A.archived(pages.limit(0)).count() == 0


def test_warc_filters_and_foreign_archives(spark, tmp_path):
    records = [A.record(i, f"http://h/{i}", b"p" * i * 1000, None, False) for i in range(6)] + [A.record(9, "http://h/9", b"p", 5, True)]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "foreign.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "own.warc.gz").write_bytes(b"".join(map(A._member, records)))
    assert gzip.decompress((tmp_path / "own.warc.gz").read_bytes()) == b"".join(records)
    for name in ("plain.warc", "foreign.warc.gz", "own.warc.gz"):
        df = A.read_warc(spark, f"file://{tmp_path}/{name}")
        assert [len(r["payload"]) if r["payload"] is not None else None for r in df.orderBy("page_id").collect()] == [0, 1000, 2000, 3000, 4000, 5000, None]
        some = df.where("record_type = 'response' and target_uri in ('http://h/3', 'http://h/9')")
        assert [r["page_id"] for r in some.collect()] == [3]
        assert A.read_warc(spark, f"file://{tmp_path}/{name}", payload=False).where("payload is not null").count() == 0
    assert A.read_warc(spark, f"file://{tmp_path}").count() == 21


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, columns = docs, docs.columns
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    from tessera.llm import decontamination as D
    from tessera.llm import jaccard_join as J
    from tessera.llm import substring_dedup as S

    groups = {r["doc_id"]: r["class_id"] for r in J.near_duplicates(first).collect()}
    assert len({groups[d] for d in ids}) == len(ids) >= 0.98 * len(set(groups.values()))
    assert D.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
    assert S.repeats(docs).agg(F.sum("n_removed")).first()[0] <= 30
    packed = C.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids


@pytest.mark.parametrize("buckets, bucket", [((1, 1), 0), ((1, 1), 1)])
def test_counts_over_32_bits(buckets, bucket):
    """A word or pair seen several billion times keeps its count, and its sums in the parent."""
    model = Y._Model(*buckets)
    keys, counts = np.array([5, 9], np.uint64), np.array([3_000_000_000, 2])
    sent = [(bucket, block, 2, Y.B.squeeze_sorted(keys), Y._pack(counts)) for block in (0, 1)]
    report, *answers = model.count(bucket, sent)
    got = [Y._gather(keys, 1, {bucket: a[2:]}, bucket) for a in answers]
    shift = 1 if bucket else 0
    assert [(g >> shift).tolist() for g in got] == [[6_000_000_000, 4]] * 2
    assert json.loads(report[4])["n"] == 6_000_000_004
    if bucket:
        assert [(g & 1).tolist() for g in got] == [[1, 1], [0, 0]]
    else:
        model.totals = {"parent_discount": 0.5, "v": 2}
        sent = [(0, block, 2, Y.B.squeeze_sorted(keys), Y._pack(np.array([3_000_000_000, 2, 5_000_000_000, 1]))) for block in (0, 1)]
        sums, first, _ = model.seat_parent(1)(0, sent)
        customers, tables, held = Y._unpack(first[3], 6).reshape(3, 2)
        assert customers.tolist() == [6_000_000_000, 4] and held.tolist() == [10_000_000_000, 2]
        assert json.loads(sums[4])["customers"] == 6_000_000_004 and 0 < tables[0] < customers[0]


def test_warc_members_of_several_records(spark, tmp_path):
    """Six records in one gzip member, and two members of three: none is lost, wanted or not, with payloads or without."""
    records = [A.record(i, f"http://h/{i}", b"p\r\n\r\n" * i * 1000, None, False) for i in range(6)]
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(b"".join(records[:3])) + gzip.compress(b"".join(records[3:])))
    (tmp_path / "known.warc.gz").write_bytes(A._member(b"".join(records)) + A._member(b"".join(records)))
    for name, times in (("one", 1), ("two", 1), ("known", 2)):
        df = A.read_warc(spark, f"file:{tmp_path}/{name}.warc.gz")
        assert sorted(len(r["payload"]) for r in df.collect()) == sorted([i * 5000 for i in range(6)] * times)
        assert [r["page_id"] for r in df.where("target_uri = 'http://h/4'").collect()] == [4] * times
        assert A.read_warc(spark, str(tmp_path / f"{name}.warc.gz"), payload=False).count() == 6 * times


def test_members_beyond_32_bits_have_no_lengths(monkeypatch):
    record = A.record(1, "http://h", b"p" * 5000, None, False)
    monkeypatch.setattr(A, "MOST_KNOWN", 1000)
    member = A._member(record)
    assert b"sl" not in member[:24] and gzip.decompress(member) == record


def test_paths():
    from tessera.llm._store import uri

    assert [uri(p) for p in ("file:/a/b", "/a/b", "file:///a/b", "hdfs:/a", "hdfs://n/a", "s3://b/k")] == ["file:///a/b", "file:///a/b", "file:///a/b", "hdfs:///a", "hdfs://n/a", "s3://b/k"]


def test_nothing_is_left_behind(spark):
    """Tables leave the catalog at once, and a scope's files are gone at its end."""
    import os

    from tessera.llm import _store as K

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = K.shared_dir(spark).removeprefix("file://").removeprefix("file:") + "/tessera"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    with K.scratch(spark):
        Y.scores(docs).count()
        A.archived(spark.read.parquet(f"{SF}/pages.parquet")).count()
        assert set(os.listdir(folder)) - before
    assert set(os.listdir(folder)) <= before
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tessera_")]
