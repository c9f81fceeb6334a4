"""Queries that write tables to files of some form, and read these."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import answers as N
from tessera.operators import code_graph as CG
from tessera.operators import graph as G
from tessera.plans.registry import query, scratch_path, table
from tessera.plans.retrieval_queries import _PAIRS, _dense
from tessera.sources import files

_DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@query("SELECT doc_id, md5(text) AS text, lang, source, n_chars FROM documents")
def s1_s2_jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    files.write_jsonl(table(spark, sf_dir, "documents"), path)
    return files.read_jsonl(spark, path, _DOC_SCHEMA).withColumn("text", F.md5("text"))


@query("SELECT region.* FROM region")
def s3_s4_placed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of which none is broken."""
    path = scratch_path(spark, "rows")
    files.write_jsonl(table(spark, sf_dir, "region"), path)
    return files.read_rows(spark, path, "r_regionkey int, r_name string")


def _text_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _dense(spark, sf_dir, 10)
    return run.select(F.col("qid").cast("string").alias("qid"), F.col("did").cast("string").alias("did"), F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


@query(_PAIRS + "SELECT qid::VARCHAR AS qid, did::VARCHAR AS did, r1::INT AS rank, round(s1, 6) AS score, 'run' AS run_id FROM ranked WHERE r1 <= 5")
def s5_s6_trec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of depth 10 written as TREC lines, read to depth 5."""
    path = scratch_path(spark, "trec")
    files.write_trec(_text_run(spark, sf_dir), path, "run")
    return files.read_trec(spark, path, 5)


@query(_PAIRS + "SELECT qid::VARCHAR AS qid, did::VARCHAR AS did, r1::INT AS rank, round(s1, 6) AS score, 'run' AS run_id FROM ranked WHERE r1 <= 10")
def s5_s8_trec_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run zipped into one member, and read from there."""
    path = scratch_path(spark, "zip")
    lines = files.trec_lines(_text_run(spark, sf_dir), "run")
    files.write_zip(lines, path, "run.txt")
    return files.read_trec_zip(spark, path, "run.txt")


@query("SELECT doc_id % 50 AS qid, doc_id AS did FROM labels WHERE quality > 0 GROUP BY ALL")
def s9_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "qrels")
    labels = table(spark, sf_dir, "labels")
    labels.select((F.col("doc_id") % 50).alias("qid"), F.lit(0).alias("q0"), "doc_id", "quality").write.option("sep", "\t").csv(path)
    return files.read_qrels(spark, path).select(F.col("qid").cast("long").alias("qid"), F.col("did").cast("long").alias("did"))


@query("SELECT n_nationkey::VARCHAR AS qid, n_name AS query FROM nation")
def s9_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "topics")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.option("sep", "\t").csv(path)
    return files.read_topics(spark, path)


@query("SELECT p_partkey AS cid, p_retailprice AS score, p_partkey * 2 AS pos FROM part")
def s15_score_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores read from a file, matched to the wanted ids in another order."""
    path = scratch_path(spark, "scores")
    part = table(spark, sf_dir, "part")
    files.write_jsonl(part.select(F.col("p_partkey").alias("cid"), F.col("p_retailprice").alias("score")), path)
    cached = files.read_jsonl(spark, path, "cid long, score double")
    wanted = part.select(F.col("p_partkey").alias("cid"), (F.col("p_partkey") * 2).alias("pos"))
    return files.check_scores(cached, wanted).select("cid", "score", "pos")


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey * 1.5 AS number FROM nation".replace("n_regionkey * 1.5", "(n_regionkey * 1.5)::DOUBLE"))
def s13_spreadsheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook of a small table, read cell by cell; texts are inline."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", (F.col("n_regionkey") * 1.5).alias("number"))
    ns = "xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'"
    cells = F.format_string("<row><c r='A1'><v>%d</v></c><c r='B1' t='inlineStr'><is><t>%s</t></is></c><c r='C1'><v>%.2f</v></c></row>", "n_nationkey", "n_name", "number")
    # A workbook is a small file by nature: 25 rows here.
    sheet = nation.agg(F.array_join(F.collect_list(cells), "").alias("x")).first()["x"]
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets><sheet name='S'/></sheets></workbook>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    rows = files.read_xlsx(book)["S"]
    return spark.createDataFrame([(int(a), b, c) for a, b, c in rows], "key int, name string, number double")


@query("SELECT vec_id, label AS chunk, round(embedding[1]::DOUBLE * 2, 6) AS x FROM embeddings")
def s17_corpus_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the chunks encoded in a first run that ends early, the others in a second, which leaves these alone."""
    path = scratch_path(spark, "corpus")
    corpus = table(spark, sf_dir, "embeddings").select(F.col("label").alias("chunk"), "vec_id", "embedding")
    double = lambda rows: rows.select("chunk", "vec_id", F.round(F.get("embedding", F.lit(0)).cast("double") * 2, 6).alias("x"))
    files.append_chunks(spark, corpus.where("chunk < 5"), path, double)
    return files.append_chunks(spark, corpus, path, double).select("vec_id", F.col("chunk").cast("int").alias("chunk"), "x")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python module for each nation: its region's class, with a method that calls the next nation's function."""
    nation = table(spark, sf_dir, "nation")
    body = F.format_string("\"\"\"Of %s.\"\"\"\nfrom base import r%d\n\n\nclass C%d(r%d):\n    def m(self, a, b: int = %d, *rest) -> str:\n        return f%d(a)\n\n\ndef f%d(x):\n    return f%d(x)\n", *(F.col(c) for c in ("n_name", "n_regionkey", "n_nationkey", "n_regionkey", "n_nationkey", "n_nationkey", "n_nationkey", "next")))
    return nation.withColumn("next", F.col("n_nationkey") + 1).select(F.format_string("p/n%d.py", "n_nationkey").alias("path"), body.alias("content"))


@query("SELECT 'n' || n_nationkey || '.py' AS file, n_name AS name FROM nation WHERE n_nationkey % 5 <> 0")
def s18_source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a tree, without hidden folders (every fifth nation's)."""
    path = scratch_path(spark, "tree")
    store = files.open_store(path)
    for r in table(spark, sf_dir, "nation").collect():
        files.write_file(store, f"{path}/{'.hidden' if r['n_nationkey'] % 5 == 0 else 'src'}/n{r['n_nationkey']}.py", r["n_name"].encode())
    found = files.source_files(spark, path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content").alias("name"))


_ENTITIES = "SELECT 'p/n' || n_nationkey || '.py::p.n' || n_nationkey AS id, 'MODULE' AS kind, 'n' || n_nationkey AS name FROM nation UNION ALL SELECT 'p/n' || n_nationkey || '.py::C' || n_nationkey, 'CLASS', 'C' || n_nationkey FROM nation UNION ALL SELECT 'p/n' || n_nationkey || '.py::C' || n_nationkey || '.m', 'FUNCTION', 'm' FROM nation UNION ALL SELECT 'p/n' || n_nationkey || '.py::f' || n_nationkey, 'FUNCTION', 'f' || n_nationkey FROM nation"


@query(_ENTITIES)
def g13_g15_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = CG.ParserRegistry()
    others = _sources(spark, sf_dir).withColumn("path", F.concat("path", F.lit(".txt")))
    return registry.entities(_sources(spark, sf_dir).unionByName(others)).select("id", "kind", "name")


@query("SELECT k AS kind, count(*)::BIGINT AS n FROM nation, (SELECT unnest(['CONTAINS', 'CONTAINS', 'CONTAINS', 'IMPORTS', 'INHERITS', 'CALLS', 'CALLS']) AS k) GROUP BY k")
def g13_relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CG.relations(_sources(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS key, p AS parameter, CASE p WHEN 'b' THEN 'int' WHEN 'return' THEN 'str' END AS annotation, CASE p WHEN 'b' THEN n_nationkey::VARCHAR END AS \"default\", CASE p WHEN 'self' THEN 0 WHEN 'a' THEN 1 WHEN 'b' THEN 2 WHEN '*rest' THEN 3 ELSE -1 END AS pos FROM nation, (SELECT unnest(['self', 'a', 'b', '*rest', 'return']) AS p)")
def h20_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = CG.parameters(_sources(spark, sf_dir)).where("id like '%.m'")
    return rows.select(F.regexp_extract("id", r"::C(\d+)", 1).cast("int").alias("key"), "parameter", "annotation", "default", "pos")


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    src = _sources(spark, sf_dir)
    nodes = CG.entities(src)
    edges = G.resolve_edges(CG.relations(src), nodes.select("id", "name", F.monotonically_increasing_id().alias("seq")))
    return nodes, edges.select("src", "dst", "kind")


@query("SELECT 'p/n0.py::C0.m' AS seed, 'p/n' || k || '.py::f' || k AS node, k + 1 AS step, k + 1 AS depth FROM (SELECT unnest(range(10))::INT AS k) UNION ALL SELECT 'p/n0.py::C0.m', 'p/n0.py::C0.m', 0, 0")
def g3_trace_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a method of the first module through the chain of calls, ten steps deep."""
    nodes, edges = _calls(spark, sf_dir)
    seeds = nodes.where("id = 'p/n0.py::C0.m'").select(F.col("id").alias("seed"))
    return CG.trace_calls(nodes, edges, seeds, 10).select("seed", "node", "step", "depth")


@query("SELECT 'p/n3.py::p.n3' AS seed, CASE k WHEN 0 THEN 'p/n3.py::p.n3' ELSE 'p/n' || (k + 2) || '.py::f' || (k + 2) END AS node, k AS step FROM (SELECT unnest(range(5))::INT AS k)")
def g4_trace_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best next entity at every step: calls before others, functions before classes."""
    nodes, edges = _calls(spark, sf_dir)
    kinds = nodes.select(F.col("id").alias("dst"), F.col("kind").alias("to"))
    weighed = edges.join(kinds, "dst").select("src", "dst", (F.when(F.col("kind") == "CALLS", 10).otherwise(0) + F.when(F.col("to") == "FUNCTION", 5).when(F.col("to") == "CLASS", 3).otherwise(0)).alias("priority"))
    return G.follow(weighed, nodes.where("id = 'p/n3.py::p.n3'").select(F.col("id").alias("seed")), 5).select("seed", "node", "step")


@query("SELECT 'CALLS' AS kind, true AS valid, 49::BIGINT AS n UNION ALL SELECT 'CALLS', false, 1 UNION ALL SELECT 'CONTAINS', true, 75 UNION ALL SELECT 'IMPORTS', false, 25 UNION ALL SELECT 'INHERITS', false, 25")
def f21_valid_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations whose ends are of kinds that may be joined so; imports and bases lead out of the sources."""
    nodes, edges = _calls(spark, sf_dir)
    return CG.valid_relationships(edges, nodes).groupBy("kind", "valid").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS qid, 'p/n' || k || '.py::' || t || k AS id, CASE t WHEN 'f' THEN 1 ELSE 2 END AS place FROM (SELECT n_nationkey, n_nationkey AS k, unnest(['f', 'C']) AS t FROM nation WHERE n_nationkey >= 10)")
def f22_d9_mentioned_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that name a function and a class; names of two characters are passed over."""
    nodes = CG.entities(_sources(spark, sf_dir))
    k = F.col("n_nationkey").cast("string")
    questions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("How does F"), k, F.lit(" work, or c"), k, F.lit("?")).alias("question"))
    return CG.mentioned(questions, nodes)


@query("SELECT n_regionkey AS community, 4 * count(*)::BIGINT AS n, count(*)::BIGINT AS files FROM nation GROUP BY n_regionkey")
def a27_community_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as communities of the entities of their nations' modules."""
    nodes = CG.entities(_sources(spark, sf_dir))
    region = table(spark, sf_dir, "nation").select(F.format_string("p/n%d.py", "n_nationkey").alias("path"), F.col("n_regionkey").alias("community"))
    out = CG.community_summaries(nodes, nodes.join(region, "path").select(F.col("id").alias("node"), "community"))
    return out.where("shown like 'CLASS: C%; FUNCTION: %; MODULE: n%'").select("community", "n", "files")


@query("SELECT doc_id, doc_id % 3 AS graph_facts, doc_id % 2 AS other_facts, len(regexp_extract_all(lower(text), 'may|might|could|likely'))::INT AS hedges, CASE WHEN doc_id % 3 > doc_id % 2 THEN 'graph' WHEN doc_id % 3 < doc_id % 2 THEN 'other' WHEN regexp_matches(lower(text), 'may|might|could|likely') THEN 'graph' ELSE 'even' END AS verdict FROM (SELECT doc_id::INT AS doc_id, text FROM documents)")
def a28_answer_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = lambda n: F.repeat(F.lit("a/b.py "), (F.col("doc_id") % n).cast("int"))
    bare = F.regexp_replace("text", r"\.py|->|→", "")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("doc_id"), CG.answer_comparison(facts(3), F.concat(facts(2), bare)).alias("c"))
    return rows.select("doc_id", "c.*")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey || '|x{' || o_custkey || '}' WHEN 1 THEN '7' WHEN 2 THEN '' ELSE 'a{b}' END AS boxed FROM orders")
def t33_boxed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(r"CASE o_orderkey % 4 WHEN 0 THEN concat('so \\boxed{', o_custkey, '} and \\boxed { x{', o_custkey, '} }') WHEN 1 THEN '\\boxed 7 end' WHEN 2 THEN '\\boxed{never' ELSE 'is \\boxed{a{b}}.' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(N.boxed_candidates(text), "|").alias("boxed"))


@query("SELECT 'nodes' AS what, 100::BIGINT AS n UNION ALL SELECT 'edges', 175")
def s21_graph_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "graph")
    nodes, edges = _calls(spark, sf_dir)
    CG.write_graph(path, nodes=nodes, edges=edges)
    out = [df.agg(F.lit(name).alias("what"), F.count("*").alias("n")) for name, df in zip(("nodes", "edges"), CG.read_graph(spark, path, "nodes", "edges"))]
    return out[0].unionByName(out[1])


@query("SELECT 'f' || k AS name, 'p/n' || k || '.py::f' || k AS id, 'p/n' || j || '.py::f' || j AS node, k - j AS depth FROM (SELECT unnest([12, 20]) AS k), (SELECT unnest(range(25))::INT AS j) WHERE j <= k AND k - j <= 3 UNION ALL SELECT 'f' || k, 'p/n' || k || '.py::f' || k, 'p/n' || j || '.py::C' || j || '.m', k - j + 1 FROM (SELECT unnest([12, 20]) AS k), (SELECT unnest(range(25))::INT AS j) WHERE j <= k AND k - j + 1 <= 3".replace("k - j AS depth", "(k - j)::INT AS depth").replace("k - j + 1 FROM", "(k - j + 1)::INT FROM"))
def h19_impact_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls two functions, over three steps: functions of earlier modules, and their methods."""
    nodes, edges = _calls(spark, sf_dir)
    names = spark.createDataFrame([("f12",), ("f20",)], "name string")
    return CG.impact_of(names, nodes, edges.where("kind = 'CALLS'"), 3).select("name", "id", "node", "depth")


@query("SELECT n_nationkey AS qid, ['impact', 'flow', 'global'][n_nationkey % 3 + 1] AS kind, CASE WHEN n_nationkey % 3 < 2 AND n_nationkey >= 10 THEN 'p/n' || n_nationkey || '.py::f' || n_nationkey END AS id FROM nation")
def g11_g12_graph_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of three kinds: their kind, and the entity that they are about; names of two characters are passed over."""
    nodes, edges = _calls(spark, sf_dir)
    k = F.col("n_nationkey").cast("string")
    lead = F.element_at(F.array(F.lit("What would break without f"), F.lit("Trace f"), F.lit("Overview of f")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    questions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("qid"), F.concat(lead, k, F.lit("?")).alias("question"))
    return CG.graph_answers(questions, nodes, edges).select("qid", "kind", "id").distinct()
