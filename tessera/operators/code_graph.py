"""Code entities and relations from Python sources, call traces, communities."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.planning import question_type
from tessera.operators._lineage import cut
from tessera.operators.graph import dependents, keyword_search, reach, undirected

ENTITY = "id string, name string, qualified string, kind string, path string, start_line int, end_line int, docstring string"
RELATION = "src string, target string, kind string, line int"
Parser = Callable[[str, str], tuple[list[tuple], list[tuple]]]
# Words of a question that name nothing, words that hedge.
SKIPPED_WORDS = "what how does the and for this that with from are was will can would could should about between impact change break affect handle work trace flow show".split()
HEDGES = ("may", "might", "could", "likely")
#: Names that are compared with all entities at a time.
MOST_NAMES = 100_000


def parse_source(path: str, content: str) -> tuple[list[tuple], list[tuple]]:
    """Entities and relations of one file: module, direct classes and functions and their members; contains, imports, inherits, calls."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return [], []
    module = path.removesuffix(".py").replace("/", ".").strip(".")
    top = f"{path}::{module}"
    entities = [(top, module.split(".")[-1], module, "MODULE", path, 1, content.count("\n") + 1, ast.get_docstring(tree))]
    relations: list[tuple] = []

    def calls(node: ast.AST, owner: str) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(x, ast.Call):
                relations.append((owner, ast.unparse(x.func), "CALLS", x.lineno))
            calls(x, owner)

    def visit(node: ast.AST, owner: str, scope: str) -> None:
        calls(node, owner)
        for x in node.body:
            if isinstance(x, (ast.Import, ast.ImportFrom)):
                base = getattr(x, "module", None)
                relations.extend((owner, f"{base}.{a.name}" if base else a.name, "IMPORTS", x.lineno) for a in x.names)
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{scope}.{x.name}" if scope else x.name
                own = f"{path}::{name}"
                kind = "CLASS" if isinstance(x, ast.ClassDef) else "FUNCTION"
                entities.append((own, x.name, name, kind, path, x.lineno, x.end_lineno, ast.get_docstring(x)))
                relations.append((owner, own, "CONTAINS", x.lineno))
                if kind == "CLASS":
                    relations.extend((own, ast.unparse(b), "INHERITS", x.lineno) for b in x.bases)
                visit(x, own, name)

    visit(tree, top, "")
    return entities, relations


def _parsed(files: DataFrame, which: int, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for p, c in zip(frame["path"], frame["content"]) for r in parse_source(p, c)[which]]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def entities(files: DataFrame) -> DataFrame:
    return _parsed(files, 0, ENTITY)


def relations(files: DataFrame) -> DataFrame:
    return _parsed(files, 1, RELATION)


def trace_calls(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 10) -> DataFrame:
    """(seed, step, node, depth): calls from each seed in source order, depth first, every function once.

    The reachable part is found by joins; one seed's part, which is small, is then walked in a task.
    """
    calls = edges.where("kind = 'CALLS'").select("src", "dst").distinct()
    near = reach(calls, seeds, depth).select("seed", F.col("node").alias("src"))
    functions = nodes.where("kind = 'FUNCTION'").select(F.col("id").alias("dst"), "start_line")
    own = near.join(calls, "src", "left").join(functions, "dst", "left").select("seed", "src", "dst", "start_line")

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        seed = frame["seed"].iloc[0]
        known = frame.dropna(subset=["dst", "start_line"]).sort_values(["start_line", "dst"])
        children = {k: v.tolist() for k, v in known.groupby("src")["dst"]}
        rows, seen, stack = [], set(), [(seed, 0)]
        while stack:
            node, at = stack.pop()
            if node in seen or at > depth:
                continue
            seen.add(node)
            rows.append((seed, len(rows), node, at))
            stack.extend((c, at + 1) for c in reversed(children.get(node, [])))
        return pd.DataFrame(rows, columns=["seed", "step", "node", "depth"])

    return own.groupBy("seed").applyInPandas(walk, "seed string, step int, node string, depth int")


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community) by local moves that raise modularity, all nodes of one parity of a hash at a time.

    A node joins the neighbouring community with the most links less what its degree
    leads one to expect; communities are named by a node of theirs.  The moves of half the
    nodes a round keep neighbours from swapping places for ever.
    """
    links = cut(undirected(edges))
    degree = links.groupBy("src").agg(F.count("*").alias("k")).withColumnRenamed("src", "node")
    two_m = links.count()
    now = degree.select("node", F.col("node").alias("community"))
    for turn in range(rounds):
        sizes = now.join(degree, "node").groupBy("community").agg(F.sum("k").alias("total"))
        to = now.select(F.col("node").alias("dst"), F.col("community").alias("c"))
        near = links.join(to, "dst").groupBy(F.col("src").alias("node"), F.col("c").alias("community")).agg(F.count("*").alias("links"))
        own = now.join(degree, "node").select("node", "k", F.col("community").alias("mine"))
        scored = near.join(own, "node").join(sizes, "community")
        held = F.when(F.col("community") == F.col("mine"), F.col("total") - F.col("k")).otherwise(F.col("total"))
        gain = F.col("links") - F.col("k") * held / F.lit(float(max(two_m, 1)))
        best = scored.groupBy("node").agg(F.max_by("community", F.struct(F.round(gain, 9), (F.col("community") == F.col("mine")).cast("int"), "community")).alias("new"), F.max(F.round(gain, 9)).alias("gain"))
        moves = F.pmod(F.xxhash64("node"), F.lit(2)) == turn % 2
        new = now.join(best, "node", "left").select("node", F.when(moves & (F.col("gain") > 0), F.coalesce("new", "community")).otherwise(F.col("community")).alias("community"))
        now = cut(new)
    return now


def parameters(files: DataFrame) -> DataFrame:
    """(id, pos, parameter, annotation, default) of every function's parameters, and (pos -1) its return annotation."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for p, c in zip(frame["path"], frame["content"]) for r in parse_parameters(p, c)]
            yield pd.DataFrame(rows, columns=["id", "pos", "parameter", "annotation", "default"])

    return files.select("path", "content").mapInPandas(run, "id string, pos int, parameter string, annotation string, default string")


def parse_parameters(path: str, content: str) -> list[tuple]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return []
    shown = lambda x: None if x is None else ast.unparse(x)
    rows: list[tuple] = []
    waiting: list[tuple[ast.AST, str]] = [(tree, "")]
    while waiting:
        node, scope = waiting.pop()
        for x in ast.iter_child_nodes(node):
            named = isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
            own = f"{scope}.{x.name}".lstrip(".") if named else scope
            if named and not isinstance(x, ast.ClassDef):
                a = x.args
                plain = [*a.posonlyargs, *a.args]
                defaults = [None] * (len(plain) - len(a.defaults)) + a.defaults
                every = [(p.arg, p.annotation, d) for p, d in zip(plain, defaults)]
                every += [("*" + a.vararg.arg, a.vararg.annotation, None)] if a.vararg else []
                every += [(p.arg, p.annotation, d) for p, d in zip(a.kwonlyargs, a.kw_defaults)]
                every += [("**" + a.kwarg.arg, a.kwarg.annotation, None)] if a.kwarg else []
                rows += [(f"{path}::{own}", k, n, shown(t), shown(d)) for k, (n, t, d) in enumerate(every)]
                if x.returns is not None:
                    rows.append((f"{path}::{own}", -1, "return", shown(x.returns), None))
            waiting.append((x, own))
    return rows


class ParserRegistry:
    """Parsers of source files by extension; a parser gives (entities, relations) of (path, content)."""

    def __init__(self) -> None:
        self._parsers: dict[str, Parser] = {}
        self.register(".py", parse_source)

    def register(self, extension: str, parser: Parser) -> None:
        self._parsers[extension] = parser

    @property
    def extensions(self) -> set[str]:
        return set(self._parsers)

    def parser(self, path: str) -> Parser | None:
        return next((p for e, p in self._parsers.items() if path.endswith(e)), None)

    def entities(self, files: DataFrame) -> DataFrame:
        return self._parsed(files, 0, ENTITY)

    def relations(self, files: DataFrame) -> DataFrame:
        return self._parsed(files, 1, RELATION)

    def _parsed(self, files: DataFrame, which: int, schema: str) -> DataFrame:
        """The rows of files of known extensions; others are passed over."""
        names, parser = [c.split()[0] for c in schema.split(", ")], self.parser

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = [r for path, content in zip(frame["path"], frame["content"]) if parser(path) for r in parser(path)(path, content)[which]]
                yield pd.DataFrame(rows, columns=names)

        return files.select("path", "content").mapInPandas(run, schema)


#: Kinds of entities that each kind of relation may join, source and target: fixed values.
RELATIONSHIPS = {
    "CONTAINS": [("MODULE", "CLASS"), ("MODULE", "FUNCTION"), ("CLASS", "FUNCTION"), ("CLASS", "CLASS"), ("FUNCTION", "FUNCTION"), ("FUNCTION", "CLASS")],
    "IMPORTS": [("MODULE", "MODULE"), ("MODULE", "CLASS"), ("MODULE", "FUNCTION")],
    "INHERITS": [("CLASS", "CLASS")],
    "CALLS": [("FUNCTION", "FUNCTION"), ("FUNCTION", "CLASS"), ("MODULE", "FUNCTION"), ("MODULE", "CLASS"), ("CLASS", "FUNCTION")],
}


def valid_relationships(edges: DataFrame, nodes: DataFrame, allowed: dict[str, list[tuple[str, str]]] = RELATIONSHIPS) -> DataFrame:
    """``edges`` (src, dst, kind) with ``valid``: whether the kinds of the ends (nodes (id, kind)) may be joined so."""
    table = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(a).alias("src_kind"), F.lit(b).alias("dst_kind")) for k, pairs in allowed.items() for a, b in pairs))
    both = edges.join(nodes.select(F.col("id").alias("src"), F.col("kind").alias("src_kind")), "src", "left").join(nodes.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind")), "dst", "left")
    known = F.exists(table, lambda t: (t["kind"] == F.col("kind")) & (t["src_kind"] == F.col("src_kind")) & (t["dst_kind"] == F.col("dst_kind")))
    return both.withColumn("valid", F.coalesce(known, F.lit(False)))


def named_like(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id) of entities (id, name, qualified) that a name (name) means, upper and lower case alike: equal names or qualified names, else ids that end with it, else names that contain it."""
    wanted = names.select("name", F.lower("name").alias("low")).distinct()
    known = nodes.select("id", F.lower("name").alias("n"), F.lower("qualified").alias("q"), F.lower("id").alias("i"))
    exact = known.select("id", F.explode(F.array_distinct(F.array("n", "q"))).alias("low")).join(wanted, "low").select("name", "id", F.lit(0).alias("tier"))
    every, blocks = exact, max(1, -(-wanted.count() // MOST_NAMES))
    for k in range(blocks):
        # The other tiers compare a stated set of names with all entities, a block of names at a time.
        own = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("low"), F.lit(blocks)) == k)
        near = known.join(F.broadcast(own), F.contains("q", F.col("low")) | F.col("i").endswith(F.col("low")) | F.contains("n", F.col("low")))
        every = every.unionByName(near.select("name", "id", F.when(F.col("i").endswith(F.col("low")), 1).otherwise(2).alias("tier")))
    best = every.groupBy("name").agg(F.min("tier").alias("tier"))
    return every.join(best, ["name", "tier"]).select("name", "id").distinct()


def mentioned(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, id, place): entities that a question (qid, question) names by a word or by two words joined with ``_``, in the order of their first mention."""
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace("question", r"\?", ""), "[,.]", " "), r"\s+"), lambda w: w != "")
    rows = questions.select("qid", words.alias("w"))
    single = rows.select("qid", F.posexplode("w").alias("pos", "name")).where((F.length("name") > 2) & ~F.lower("name").isin(SKIPPED_WORDS))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws("_", F.get("w", i - 1), F.get("w", i)))
    joined = rows.where(F.size("w") > 1).select("qid", F.posexplode(pairs).alias("pos", "name")).withColumn("pos", F.col("pos") + (1 << 20))
    every = single.unionByName(joined)
    found = every.join(named_like(nodes, every.select("name")), "name").groupBy("qid", "id").agg(F.min(F.struct("pos", "id")).alias("at"))
    return found.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("at")).alias("place"))


def community_summaries(nodes: DataFrame, members: DataFrame, most: int = 5) -> DataFrame:
    """(community, n, files, shown) of communities (node, community): entities, files, and up to ``most`` names of each kind."""
    rows = members.join(nodes.select(F.col("id").alias("node"), "name", "kind", "path"), "node")
    place = F.row_number().over(Window.partitionBy("community", "kind").orderBy("name", "node"))
    few = rows.withColumn("r", place).where(F.col("r") <= most).groupBy("community", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ", ").alias("names"))
    shown = few.groupBy("community").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "kind", "names"))), "; ").alias("shown"))
    return rows.groupBy("community").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files")).join(shown, "community")


def answer_comparison(graph_answer: Column, other_answer: Column) -> Column:
    """Files, arrows and hedges of two answers, and which says more that can be checked."""
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    facts = lambda text: count(text, r"[\w/]+\.py") + count(text, "→|->")
    hedges = count(F.lower(other_answer), "|".join(HEDGES))
    verdict = F.when(facts(graph_answer) > facts(other_answer), "graph").when(facts(graph_answer) < facts(other_answer), "other").when(hedges > 0, "graph").otherwise("even")
    return F.struct(facts(graph_answer).alias("graph_facts"), facts(other_answer).alias("other_facts"), hedges.alias("hedges"), verdict.alias("verdict"))


def write_graph(path: str, **tables: DataFrame) -> None:
    """Nodes, edges and communities as Parquet folders in ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{path}/{n}") for n in names]


def impact_of(names: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 6) -> DataFrame:
    """(name, id, node, depth): what depends on the entities that each name (name) means, by the least number of steps; the entity itself at depth 0."""
    meant = cut(named_like(nodes, names))
    found = dependents(edges.select("src", "dst").distinct(), meant.select(F.col("id").alias("seed")).distinct(), depth)
    return meant.join(found.withColumnRenamed("seed", "id"), "id").select("name", "id", "node", "depth")


def graph_answers(questions: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 6, most: int = 15) -> DataFrame:
    """(qid, kind, id, place, node, depth): what the graph says to each question (qid, question).

    By the question's kind: what depends on the first entity that it names (impact), the
    calls from it (flow), its neighbours (relationship, local); the ``most`` nearest of each,
    ties by id.  A question that names nothing, or asks for an overview, has one row without entities.
    """
    asked = questions.select("qid", "question", question_type(F.col("question")).alias("kind"))
    first = cut(asked.select("qid", "kind").join(mentioned(questions, nodes).where("place = 1").select("qid", "id"), "qid", "left"))
    plain = edges.select("src", "dst").distinct()
    both = plain.unionByName(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    ways = {("impact",): (plain.select(F.col("dst").alias("src"), F.col("src").alias("dst")), depth), ("flow",): (edges.where("kind = 'CALLS'").select("src", "dst").distinct(), depth), ("relationship", "local"): (both, 1)}
    found = None
    for kinds, (links, steps) in ways.items():
        own = first.where(F.col("kind").isin(*kinds) & F.col("id").isNotNull())
        near = own.join(reach(links, own.select(F.col("id").alias("seed")).distinct(), steps).where("depth > 0").withColumnRenamed("seed", "id"), "id").select("qid", "kind", "id", "node", "depth")
        found = near if found is None else found.unionByName(near)
    place = F.row_number().over(Window.partitionBy("qid").orderBy("depth", "node"))
    shown = found.withColumn("place", place).where(F.col("place") <= most)
    return first.where("kind != 'global'").unionByName(first.where("kind = 'global'").withColumn("id", F.lit(None).cast("string"))).join(shown.drop("kind", "id"), "qid", "left").select("qid", "kind", "id", "place", "node", "depth")


#: What the graph's stand-in for search by meaning is: search by words.
semantic_search = keyword_search
