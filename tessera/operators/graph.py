"""Traversal, paths and statistics of entity graphs: nodes (id, ...), edges (src, dst, kind)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators._lineage import cut


def simple_edges(edges: DataFrame, order: str = "seq") -> DataFrame:
    """One edge an ordered pair: the last written one."""
    return edges.groupBy("src", "dst").agg(F.max_by("kind", order).alias("kind"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth) of all nodes within ``depth`` steps along ``edges`` (src, dst); ``seeds`` (seed).

    A frontier join a step; nodes seen before are left out of the next frontier.  Frontiers are
    checkpointed, as each is read by all later steps; an empty one ends the search.
    """
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for step in range(1, depth + 1):
        new = frontier.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        frontier = cut(new.withColumn("depth", F.lit(step)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def dependents(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Nodes that lead to a seed, by the least number of steps (impact analysis; callers where ``edges`` are calls)."""
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, depth)


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, length: int, most: int) -> DataFrame:
    """(start, end, path, hops): the ``most`` shortest simple paths of up to ``length`` edges, ignoring directions."""
    links = undirected(edges)
    paths = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("path"))
    found = None
    for _ in range(length):
        paths = paths.join(links, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"))
        done = paths.join(ends.select(F.col("node").alias("at")), "at", "left_semi")
        found = done if found is None else found.unionByName(done)
        paths = paths.join(ends.select(F.col("node").alias("at")), "at", "left_anti")
    ranked = found.select("start", F.col("at").alias("end"), "path", (F.size("path") - 1).alias("hops"))
    order = Window.partitionBy("start", "end").orderBy("hops", F.array_join("path", ">"))
    return ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, n): nodes and edges, in all and by kind; nodes that only edges name count among all nodes."""
    named = nodes.select("id").unionByName(edges.select(F.col("src").alias("id"))).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    parts = [
        named.agg(F.lit("total_nodes").alias("what"), F.count("*").alias("n")),
        edges.agg(F.lit("total_edges").alias("what"), F.count("*").alias("n")),
        nodes.groupBy(F.concat(F.lit("nodes_"), "kind").alias("what")).agg(F.count("*").alias("n")),
        edges.groupBy(F.concat(F.lit("edges_"), "kind").alias("what")).agg(F.count("*").alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` (src, target, kind) with ``dst``: the node of that id, else the first of that name, else the only one whose name ends with the last part, else the target itself (``phantom``)."""
    exact = nodes.select(F.col("id").alias("target"), F.col("id").alias("by_id"))
    named = nodes.groupBy(F.col("name").alias("target")).agg(F.min_by("id", "seq").alias("by_name"))
    last = nodes.groupBy(F.element_at(F.split("name", r"\."), -1).alias("last")).agg(F.when(F.count("*") == 1, F.min("id")).alias("by_last"))
    j = edges.join(exact, "target", "left").join(named, "target", "left").withColumn("last", F.element_at(F.split("target", r"\."), -1)).join(last, "last", "left")
    return j.select("src", "target", "kind", F.coalesce("by_id", "by_name", "by_last", "target").alias("dst"), F.coalesce("by_id", "by_name", "by_last").isNull().alias("phantom"))


#: Queries sent to every task at a time; more are searched in further passes.
QUERY_BLOCK = 4096


def keyword_search(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score): share of a query's words that a node's text contains; best ``k``.

    The stated query set is sent in blocks, a pass over the nodes each; a task keeps its own
    best ``k`` a query.  Ids are longs.
    """
    q = queries.select(F.col("qid").cast("long").alias("qid"), F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("words"))
    passes, found = max(1, -(-q.count() // QUERY_BLOCK)), None
    for turn in range(passes):
        own = [(r["qid"], r["words"]) for r in q.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == turn).collect() if r["words"]]
        sent = nodes.sparkSession.sparkContext.broadcast((sorted({w for _, ws in own for w in ws}), own))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            words, asked = sent.value
            best: dict[int, list[tuple[float, int]]] = {}
            for batch in batches:
                ids, low = batch.column("id").to_numpy(), batch.column("low")
                has = {w: pc.fill_null(pc.match_substring(low, w), False).to_numpy(zero_copy_only=False) for w in words}
                for qid, own_words in asked:
                    share = sum(has[w].astype(np.int64) for w in own_words) / len(own_words)
                    some = np.flatnonzero(share > 0)
                    top = some[np.lexsort([ids[some], -share[some]])[:k]]
                    best[qid] = sorted([*best.get(qid, []), *zip((-share[top]).tolist(), ids[top].tolist())])[:k]
            rows = [(qid, i, -s) for qid, found in best.items() for s, i in found]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["qid", "id", "score"])

        part = nodes.select(F.col("id").cast("long").alias("id"), F.lower("text").alias("low")).mapInArrow(run, "qid long, id long, score double")
        found = part if found is None else found.unionByName(part)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 8).desc(), "id")).cast("long")).where(F.col("rank") <= k)


def expand(seeds: DataFrame, edges: DataFrame, hops: int, neighbour_score: float, k: int) -> DataFrame:
    """Search hits (qid, id, score) and their neighbours within ``hops`` at a lower score; the best 2 ``k``."""
    near = reach(undirected(edges), seeds.select(F.col("id").alias("seed")).distinct(), hops).where("depth > 0")
    more = seeds.join(near, F.col("id") == F.col("seed")).select("qid", F.col("node").alias("id"), F.lit(neighbour_score).alias("score"))
    every = seeds.select("qid", "id", "score").unionByName(more).groupBy("qid", "id").agg(F.max("score").alias("score"))
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 8).desc(), "id")).cast("long")).where(F.col("rank") <= 2 * k)


def follow(edges: DataFrame, seeds: DataFrame, depth: int = 10) -> DataFrame:
    """(seed, step, node): from each seed the best next node at every step, none twice; ``edges`` (src, dst, priority).

    A join and a partial maximum a step; the least node wins among equal priorities.
    """
    at = cut(seeds.select("seed", F.col("seed").alias("node"), F.array("seed").alias("path")))
    for _ in range(depth - 1):
        j = at.join(edges, (F.col("node") == F.col("src")) & ~F.array_contains("path", F.col("dst")), "left")
        best = j.groupBy("seed").agg(F.min(F.when(F.col("dst").isNotNull(), F.struct((-F.col("priority")).alias("p"), F.col("dst").alias("d")))).alias("b"), F.first("path").alias("path"), F.count("dst").alias("n"))
        found = best.where("n > 0").select("seed", F.col("b.d").alias("node"), F.array_append("path", F.col("b.d")).alias("path"))
        ended = best.where("n = 0").select("seed", F.lit(None).cast("string").alias("node"), "path")
        at = cut(found.unionByName(ended))
        if at.where("node is not null").isEmpty():
            break
    return at.select("seed", F.posexplode("path").alias("step", "node"))
