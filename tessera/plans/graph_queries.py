"""Queries of the entity graph: region contains nation contains customer contains order; parts and suppliers by line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.plans.registry import query, table

_NODES = """nodes AS (
  SELECT 'r' || r_regionkey AS id, 'region' AS kind FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'customer' FROM customer UNION ALL SELECT 'o' || o_orderkey, 'order' FROM orders)"""
_EDGES = """edges AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'contains' AS kind FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains' FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'placed' FROM orders)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders")}
    ident = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = edges = None
    for name, p, key, kind in (("region", "r", "r_regionkey", "region"), ("nation", "n", "n_nationkey", "nation"), ("customer", "c", "c_custkey", "customer"), ("orders", "o", "o_orderkey", "order")):
        part = t[name].select(ident(p, key).alias("id"), F.lit(kind).alias("kind"))
        nodes = part if nodes is None else nodes.unionByName(part)
    for name, p, up, q, key, kind in (("nation", "r", "n_regionkey", "n", "n_nationkey", "contains"), ("customer", "n", "c_nationkey", "c", "c_custkey", "contains"), ("orders", "c", "o_custkey", "o", "o_orderkey", "placed")):
        part = t[name].select(ident(p, up).alias("src"), ident(q, key).alias("dst"), F.lit(kind).alias("kind"))
        edges = part if edges is None else edges.unionByName(part)
    return nodes, edges


@query(f"WITH {_NODES}, {_EDGES}, a AS (SELECT 'r' || n_regionkey AS seed, 'c' || c_custkey AS c, 'n' || n_nationkey AS n FROM nation JOIN customer ON c_nationkey = n_nationkey), all_ AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey, 1 FROM nation UNION SELECT seed, c, 2 FROM a UNION SELECT seed, 'o' || o_orderkey, 3 FROM a JOIN orders ON c = 'c' || o_custkey) SELECT seed, depth, count(*)::BIGINT AS n FROM all_ GROUP BY ALL")
def g2_reach_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return G.reach(edges, nodes.where("kind = 'region'").select(F.col("id").alias("seed")), 4).groupBy("seed", "depth").agg(F.count("*").alias("n"))


@query("SELECT 'o' || o_orderkey AS seed, 'r' || n_regionkey AS region FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def g1_impact_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order depends on at the third step: its region."""
    nodes, edges = _graph(spark, sf_dir)
    found = G.dependents(edges, nodes.where("kind = 'order'").select(F.col("id").alias("seed")), 3)
    return found.where("depth = 3").select("seed", F.col("node").alias("region"))


@query("SELECT 'n' || a.n_nationkey AS start, 'n' || b.n_nationkey AS end, 'n' || a.n_nationkey || '>r' || a.n_regionkey || '>n' || b.n_nationkey AS path, 2 AS hops FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def g5_g6_simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    own = nodes.where("kind = 'nation'").select(F.col("id").alias("node"))
    paths = G.simple_paths(edges.where("kind = 'contains' and dst like 'n%'"), own, own, 4, 5)
    return paths.select("start", "end", F.array_join("path", ">").alias("path"), "hops")


@query(f"WITH {_NODES}, {_EDGES} SELECT 'total_nodes' AS what, count(*)::BIGINT AS n FROM nodes UNION ALL SELECT 'total_edges', count(*)::BIGINT FROM edges UNION ALL SELECT 'nodes_' || kind, count(*)::BIGINT FROM nodes GROUP BY kind UNION ALL SELECT 'edges_' || kind, count(*)::BIGINT FROM edges GROUP BY kind")
def a26_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.stats(*_graph(spark, sf_dir))


@query(
    "WITH e AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 's' || (p_partkey % 50 + 1) WHEN 1 THEN 'Supplier#' || (p_partkey % 70 + 1) WHEN 2 THEN 'x.s' || (p_partkey % 30 + 1) ELSE 'nowhere' || p_partkey END AS target FROM part), n AS (SELECT 's' || s_suppkey AS id, s_suppkey AS seq, 'Supplier#' || s_suppkey AS name FROM supplier)"
    " SELECT p_partkey AS src, coalesce(a.id, b.id, target) AS dst, coalesce(a.id, b.id) IS NULL AS phantom FROM e LEFT JOIN n a ON a.id = target LEFT JOIN n b ON b.name = target"
)
def j9_resolve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = "CASE p_partkey % 4 WHEN 0 THEN concat('s', p_partkey % 50 + 1) WHEN 1 THEN concat('Supplier#', p_partkey % 70 + 1) WHEN 2 THEN concat('x.s', p_partkey % 30 + 1) ELSE concat('nowhere', p_partkey) END"
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.expr(target).alias("target"), F.lit("uses").alias("kind"))
    n = table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) as id", "s_suppkey as seq", "concat('Supplier#', s_suppkey) as name")
    return G.resolve_edges(e, n).select("src", "dst", "phantom")


@query("SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, arg_max(CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'sold' END, (l_orderkey, l_linenumber)) AS kind FROM lineitem GROUP BY ALL")
def j14_simple_digraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge a part and supplier: the kind of the last line item."""
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.when(F.col("l_returnflag") == "R", "returned").otherwise("sold").alias("kind"), F.struct("l_orderkey", "l_linenumber").alias("seq"))
    return G.simple_edges(e)


_WORDS = "CASE item_id % 4 WHEN 0 THEN 'the of' WHEN 1 THEN 'tion and' WHEN 2 THEN 'der die' ELSE 'la que xyz' END"
_G9 = f"""WITH q AS (SELECT item_id AS qid, string_split({_WORDS}, ' ') AS w FROM benchmark), s AS (SELECT qid, doc_id AS id, len(list_filter(w, lambda x: contains(lower(text), x))) / len(w)::DOUBLE AS score FROM q, documents), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, id) AS rank FROM s WHERE score > 0)"""


def _keyword(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.expr(_WORDS).alias("text"))
    return G.keyword_search(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), q, k)


@query(_G9 + " SELECT qid, id, round(score, 6) AS score, rank FROM k WHERE rank <= 10")
def g9_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(spark, sf_dir, 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(
    _G9
    + ", e AS (SELECT doc_id AS a, doc_id + 1 AS b FROM documents), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), t AS (SELECT qid, id, score FROM k WHERE rank <= 5), n AS (SELECT qid, b AS id, 0.3::DOUBLE AS score FROM t JOIN u ON a = id), m AS (SELECT qid, id, max(score) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM n) GROUP BY ALL), z AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, id) AS rank FROM m) SELECT qid, id, round(score, 6) AS score, rank FROM z WHERE rank <= 10"
)
def g8_g10_expanded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst"))
    return G.expand(_keyword(spark, sf_dir, 5), edges, 1, 0.3, 5).select("qid", "id", F.round("score", 6).alias("score"), "rank")
