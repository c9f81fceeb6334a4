"""Near-duplicate join on word n-grams by MinHash banding (operator 7).

1. Every text becomes the set of its 5-word shingles.  Texts with equal sets form a
   class, of which only a representative goes on.
2. A representative's MinHash values are cut into bands; band and row counts are the
   fewest that reach the target recall at the threshold.  Representatives shuffle on
   band hashes, and each is linked to the least one of its band bucket, not to all.
3. The components of these links are the candidate clusters.  All pairs of a cluster
   that can be similar by their sizes are verified on the full sets, in tiles of bounded
   size: small clusters share a task, a large one is cut by set size into tiles, and the
   pairs of tiles whose sizes allow a link are dealt over many tasks.  Inside a task,
   intersections come from matrix products over the tile's shingles; what leaves
   it is the number of links of each row and a forest of the links, never the pairs.
4. The components of the verified links are the near-duplicate groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _blocks as B
from tessera.llm._components import components
from tessera.llm._store import freeze, release
from tessera.llm._words import mix, run_starts, runs, words

N_GRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: MinHash values that a text may cost.
MOST_HASHES = 128
#: Rows and shingles of a verification tile.
TILE_ROWS = 256
TILE_SHINGLES = 1_500_000

_LAST = (1 << 63) - 1
#: A row's cluster, whether that is cut, its size class and tile there, and the tiles of the class below, its own and the one above.
_PLACE = ("cluster", "cut", "size_class", "tile", "below", "own", "above")
_U16, _U48 = np.uint64(16), np.uint64(48)
_MASK = np.uint64((1 << 48) - 1)


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most selective banding (most rows a band, then fewest bands) that finds a pair at ``threshold`` with chance ``recall``."""
    for rows in range(most, 0, -1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-chance)) if chance > 1e-12 else most + 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall with so few hashes")


def shingle_sets(text: pa.Array, n: int = N_GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit shingle hashes of all texts, rising within each, and each text's first; fewer words than ``n`` are one shingle."""
    w = words(text)
    h, ok = runs(w.hash, n), run_starts(w.first, n)
    at = np.flatnonzero(ok)
    doc = w.doc()
    key = doc[at].astype(np.uint64) << _U48 | h[at] >> _U16
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    few = [mix(np.array([np.bitwise_xor.reduce(mix(w.hash[w.first[d] : w.first[d + 1]] + np.arange(w.counts[d], dtype=np.uint64)))]))[0] for d in short]
    key = np.concatenate([key, short.astype(np.uint64) << _U48 | np.array(few, np.uint64) >> _U16])
    key = np.sort(key)
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    first = np.searchsorted(key, np.arange(w.n_docs + 1, dtype=np.uint64) << _U48)
    return key & _MASK, first


def band_hashes(shingles: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of band hashes for each text that has shingles."""
    lead = first[:-1][np.diff(first) > 0]
    x = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64))
    factor = (seeds[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    shift = (seeds[1::2] >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(lead), bands), np.uint64)
    if not len(lead):
        return out
    scratch = np.empty_like(x)
    for band in range(bands):
        mixed = np.full(len(lead), band, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            np.multiply(x, factor[k], out=scratch)
            np.add(scratch, shift[k], out=scratch)
            mixed = mix(mixed * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(scratch, lead))
        out[:, band] = mixed
    return out


def _signatures(blocks: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                docs = B.unpack(payload.as_py())
                shingles, first = shingle_sets(docs.column("text"), n)
                size = np.diff(first)
                some = np.flatnonzero(size)
                low, high = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
                if len(some):
                    low[some] = np.add.reduceat(mix(shingles), first[some])
                    high[some] = np.add.reduceat(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), first[some])
                hashes = band_hashes(shingles, first, bands, rows)
                offsets = np.zeros(len(size) + 1, np.int32)
                offsets[1:] = np.cumsum(size > 0) * bands
                yield pa.record_batch(
                    [
                        pa.array(B.row_ids(block, len(size))),
                        docs.column("doc_id").cast(pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array(low.view(np.int64)),
                        pa.array(high.view(np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64).ravel())),
                    ],
                    names=["row", "doc_id", "n", "low", "high", "bands"],
                )
                release()

    return blocks.select("block", "payload").mapInArrow(run, "row long, doc_id long, n long, low long, high long, bands array<bigint>")


def _sets(blocks: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The shingle sets of the rows of ``wanted``, with its other columns; no text is moved."""
    names = ["row", *_PLACE]
    schema = f"row long, cluster long, {', '.join(f'{c} int' for c in _PLACE[1:])}, n long, shingles binary"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = right.select(names)
        found = []
        if own.num_rows:
            docs = B.unpack(left.column("payload")[0].as_py())
            at = own.column("row").to_numpy() & (B.BLOCK_ROWS - 1)
            shingles, first = shingle_sets(docs.column("text").take(pa.array(at)), n)
            found = [shingles[first[k] : first[k + 1]] for k in range(len(at))]
        size = pa.array([len(s) for s in found], pa.int64())
        blobs = pa.array([B.squeeze_sorted(s) for s in found], pa.binary())
        return pa.table([*own.columns, size, blobs], names=[*names, "n", "shingles"])

    return blocks.select("block", "payload").groupBy("block").cogroup(wanted.withColumn("block", F.shiftright("row", B.BLOCK_BITS)).groupBy("block")).applyInArrow(run, schema)


def linked_pairs(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """``(index in a, index in b)`` of set pairs at or over ``threshold``; b None: pairs within a, each once.

    Only shingles that two sets share count; they are taken in bounded runs of columns.
    """
    every = a if b is None else a + b
    size = np.array([len(s) for s in every])
    flat, number = np.unique(np.concatenate(every), return_inverse=True)
    owner = np.repeat(np.arange(len(every)), size)
    often = np.bincount(number, minlength=len(flat)) > 1
    column = np.cumsum(often) - 1
    keep = often[number]
    owner, number = owner[keep], column[number[keep]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    cut = len(a)
    both = np.zeros((cut, len(every) - cut if b is not None else cut), np.float32)
    width, total = max(64, (1 << 21) // len(every)), int(often.sum())
    for lo in range(0, total, width):
        i, j = np.searchsorted(number, [lo, lo + width])
        x = np.zeros((len(every), min(width, total - lo)), np.float32)
        x[owner[i:j], number[i:j] - lo] = 1
        both += x[:cut] @ (x[cut:] if b is not None else x).T
    left, right = size[:cut, None], size[None, cut:] if b is not None else size[None, :]
    linked = both >= threshold * (left + right - both) - 1e-6
    if b is None:
        linked = np.triu(linked, 1)
    return np.argwhere(linked)


def _forest(rows: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The least row of each row's linked group."""
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs.tolist():
        x, y = root(i), root(j)
        if x != y:
            x, y = (x, y) if rows[x] < rows[y] else (y, x)
            parent[y] = x
    return rows[[root(i) for i in range(len(rows))]]


def _verify(table: pa.Table, threshold: float) -> pa.Table:
    """Links of the rows of some whole clusters, or of a pair of tiles of one."""
    cluster, side = table.column("cluster").to_numpy(), table.column("side").to_numpy()
    rows, sizes, blobs = table.column("row").to_numpy(), table.column("n").to_pylist(), table.column("shingles")
    # All rows of a task have one pair of tiles, though a tile may have no row.
    across = any(table.column(x)[0].as_py() != table.column(y)[0].as_py() for x, y in (("a", "b"), ("i", "j")))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.lexsort([rows, side, cluster])
    for own in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
        sets = [B.expand_sorted(blobs[i].as_py(), sizes[i], np.uint64) for i in own.tolist()]
        cut = int(np.count_nonzero(side[own] == 0)) if across else len(own)
        if across and cut in (0, len(own)):
            continue
        pairs = linked_pairs(sets[:cut], sets[cut:] if across else None, threshold)
        if across:
            pairs[:, 1] += cut
        out.append((rows[own], np.bincount(pairs.ravel(), minlength=len(own)), _forest(rows[own], pairs)))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["row", "n_links", "root"])


def _links(reps: DataFrame, blocks: DataFrame, n: int, threshold: float) -> DataFrame:
    """``(row, n_links, root)``, several of a row, of representatives (row, n, bands) in candidate clusters."""
    spark = blocks.sparkSession
    keyed = reps.select("row", F.posexplode("bands").alias("band", "hash")).select("row", F.xxhash64("band", "hash").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("row").alias("hub"), F.count("*").alias("members")).where("members > 1")
    clusters = components(keyed.join(hubs, "key").select("row", "hub"), "row", "hub")
    sized = freeze(clusters.join(reps.select(F.col("row").alias("node"), "n"), "node").select(F.col("node").alias("row"), F.col("component").alias("cluster"), "n"), "clusters")
    wanted = _tiled(sized, threshold)
    shared = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((wanted.where("cut = 0").agg(F.sum("n")).first()[0] or 0) // TILE_SHINGLES) + 1)
    sets = _sets(blocks, wanted.drop("n"), n)
    # Where a row meets others: all tiles of its own class, and those of the classes next to it.
    meetings = F.expr("""concat(
        transform(sequence(0, own - 1), x -> named_struct('a', size_class, 'b', size_class, 'i', least(tile, x), 'j', greatest(tile, x), 'side', if(tile > x, 1, 0))),
        if(below > 0, transform(sequence(0, below - 1), x -> named_struct('a', size_class - 1, 'b', size_class, 'i', x, 'j', tile, 'side', 1)), array()),
        if(above > 0, transform(sequence(0, above - 1), x -> named_struct('a', size_class, 'b', size_class + 1, 'i', tile, 'j', x, 'side', 0)), array()))""")
    dealt = (
        sets.withColumn("at", F.explode(meetings))
        .withColumn("task", F.when(F.col("cut") == 0, F.pmod(F.xxhash64("cluster"), F.lit(shared))).otherwise(F.xxhash64("cluster")))
        .select("cut", "task", "at.*", "cluster", "row", "n", "shingles")
    )

    def verify(table: pa.Table) -> pa.Table:
        out = _verify(table, threshold)
        release()
        return out

    return dealt.groupBy("cut", "task", "a", "b", "i", "j").applyInArrow(verify, "row long, n_links long, root long")


def _tiled(sized: DataFrame, threshold: float) -> DataFrame:
    """``sized`` (row, cluster, n) with the columns of ``_PLACE``.

    Sizes fall into classes such that sets at or over the threshold are in one class or in
    classes next to each other; a class of a cluster that is cut has tiles of bounded size.
    """
    pieces = F.greatest(F.ceil(F.count("*") / F.lit(TILE_ROWS)), F.ceil(F.sum("n") / F.lit(TILE_SHINGLES))).cast("int")
    cut = freeze(sized.groupBy("cluster").agg(pieces.alias("tiles")).where("tiles > 1").select("cluster"), "cut")
    # A little wider than the threshold's ratio, so that rounding can't part a pair by two classes.
    size_class = (F.floor(F.log("n") / F.lit(-math.log(threshold) * (1 + 1e-9))) if threshold < 1 else F.col("n")).cast("int")
    rows = sized.join(cut.withColumn("cut", F.lit(1)), "cluster", "left").withColumn("cut", F.coalesce("cut", F.lit(0))).withColumn("size_class", F.when(F.col("cut") == 1, size_class).otherwise(0))
    rows = freeze(rows, "classed")
    own = freeze(rows.where("cut = 1").groupBy("cluster", "size_class").agg(pieces.alias("own")), "tiles")
    near = own
    for name, by in (("below", 1), ("above", -1)):
        near = near.join(own.select("cluster", (F.col("size_class") + by).alias("size_class"), F.col("own").alias(name)), ["cluster", "size_class"], "left")
    near = freeze(near, "meetings")
    known = rows.join(near, ["cluster", "size_class"], "left")
    return freeze(
        known.select("row", "n", "cluster", "cut", "size_class", F.coalesce(F.pmod(F.xxhash64("row"), "own"), F.lit(0)).cast("int").alias("tile"), *(F.coalesce(c, F.lit(int(c == "own"))).cast("int").alias(c) for c in ("below", "own", "above"))),
        "wanted",
    )


def _grouped(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The blocks, and for each row: row, doc_id, copy_of, class_id, n_copies, n_links and kept (the row that stands for its group)."""
    bands, rows = bands_and_rows(threshold, recall)
    blocks = B.write_blocks(docs)
    signatures = freeze(_signatures(blocks, n, bands, rows), "signatures")
    least = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("d"), "row", "n", "bands")
    classes = freeze(
        signatures.where("n > 0").groupBy("low", "high").agg(F.min(least).alias("rep"), F.count("*").alias("n_copies")).select("low", "high", "n_copies", "rep.*"),
        "classes",
    )
    found = freeze(_links(classes.select("row", "n", "bands"), blocks, n, threshold), "links")
    groups = components(found.select("row", "root"), "row", "root")
    counts = found.groupBy("row").agg(F.sum("n_links").alias("n_links"))
    # Written, so that each join below reads its sides by the join's own exchanges, and Spark can split a hot key.
    known = freeze(
        classes.select("low", "high", "n_copies", F.col("row").alias("rep"), F.col("d").alias("copy_of"))
        .join(counts.withColumnRenamed("row", "rep"), "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep")),
        "known",
    )
    first = freeze(known.groupBy("component").agg(F.min(F.struct(F.col("copy_of").alias("d"), F.col("rep").alias("row"))).alias("first")).select("component", F.col("first.d").alias("class_id"), F.col("first.row").alias("kept")), "groups")
    placed = freeze(known.join(first, "component"), "placed")
    out = signatures.select("row", "doc_id", "n", "low", "high").join(placed, ["low", "high"], "left")
    empty = F.col("n") == 0
    own = {"copy_of": F.col("doc_id"), "class_id": F.col("doc_id"), "n_copies": F.lit(1).cast("long"), "n_links": F.lit(0).cast("long"), "kept": F.col("row")}
    columns = [F.when(empty, alone).otherwise(F.col(c) if c != "n_links" else F.coalesce(c, F.lit(0))).alias(c) for c, alone in own.items()]
    none = F.lit(_LAST)
    return blocks, out.select("row", "doc_id", *columns).withColumns({c: F.when(F.col(c) != none, F.col(c)) for c in ("copy_of", "class_id")})


def near_duplicates(docs: DataFrame, n: int = N_GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The near-duplicate group and number of links of each row of ``docs`` (doc_id, text).

    Returns doc_id; class_id, the least doc_id of its group (rows joined by chains of
    links at or over ``threshold``); copy_of, the least doc_id with the same shingle set;
    n_copies, the rows with that set; and n_links, how many other sets it is linked to.
    A null or wordless text is a group of its own; a text of fewer than ``n`` words is
    one shingle; repeated rows get a row each; a null doc_id counts as the largest;
    further columns are ignored; no rows give no rows.
    """
    _, rows = _grouped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), n, threshold, recall)
    return rows.select("doc_id", "class_id", "copy_of", "n_copies", "n_links")


def keep_one(docs: DataFrame, n: int = N_GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs``, all columns, without near duplicates: of each group the row of the least doc_id stays (of equal ids, the first read).

    Null, empty and wordless texts all stay; repeated rows are copies of each other; a null
    doc_id counts as the largest; columns may have any name; no rows give no rows.
    """
    cast = docs.withColumn("text", F.col("text").cast("string"))
    blocks, rows = _grouped(cast, n, threshold, recall)
    kept = rows.where("row = kept").select("row", F.shiftright("row", B.BLOCK_BITS).alias("block"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = np.sort(right.column("row").to_numpy() & (B.BLOCK_ROWS - 1))
        return pa.Table.from_batches([B.unpack(left.column("payload")[0].as_py()).take(pa.array(at))])

    return blocks.select("block", "payload").groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(run, cast.schema)
