"""Parameters as text: weights, counts, task selectors; instructions and prompts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Reranking tasks (dataset, name on the leaderboard, language), keys of texts in records, prompts.
RERANKING_TASKS = [
    ("FinanceMTEB/FinEvaRetrieval-reranking", "FinEvaReranking", "zh"),
    ("FinanceMTEB/DISCFinLLM-reranking", "DISCFinLLMReranking", "zh"),
    ("FinanceMTEB/FinFact-reranking", "FinFactReranking", "en"),
    ("FinanceMTEB/FiQA-reranking", "FiQA2018Reranking", "en"),
    ("FinanceMTEB/HPC3-reranking", "HC3Reranking", "en"),
]
TEXT_KEYS = "text contents content passage document doc".split()
QUERY_KEYS = "query question sentence text".split()
POSITIVE_KEYS = "positive positives positive_passages relevant_docs".split()
NEGATIVE_KEYS = "negative negatives negative_passages hard_negatives".split()
ID_KEYS = "query_id qid id".split()
MATH_PROMPT = "Solve each grade school math problem. Give the reasoning, then end with '#### <answer>'."
BOXED_PROMPT = "Here are some examples of how to solve similar problems:"
BOXED_LAST = "Please reason step by step, and put your final answer within \\boxed{}."


def safe_label(value: str) -> str:
    """A label of letters, digits, dots, dashes and underscores."""
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", value.strip()).strip("_") or "weights"


def weights(spec: str) -> tuple[str, float, float, float]:
    """(label, dense, sparse, multi-vector) of ``label:d,s,m`` or ``d,s,m``; none negative, not all zero."""
    label, _, values = spec.rpartition(":")
    found = [float(x) for x in values.split(",")]
    if len(found) != 3 or min(found) < 0 or not any(found):
        raise ValueError(f"three weights, none negative and not all zero, are wanted: {spec!r}")
    return (safe_label(label or "_".join(f"{n}{x:g}" for n, x in zip("dsc", found))), *found)


def weight_grid(specs: list[str]) -> list[tuple[str, float, float, float]]:
    """The weights of each spec; labels must differ."""
    grid = [weights(s) for s in specs]
    _distinct([g[0] for g in grid])
    return grid


def _distinct(labels: list[str]) -> None:
    twice = {x for x in labels if labels.count(x) > 1}
    if twice:
        raise ValueError(f"given more than once: {', '.join(sorted(twice))}")


def _pairs(text: str) -> list[tuple[str, str]]:
    parts = [p.strip() for p in text.split(",") if p.strip()]
    if any("=" not in p or not p.split("=", 1)[0].strip() for p in parts):
        raise ValueError(f"entries are label=number: {text!r}")
    return [(label.strip(), number) for label, number in (p.split("=", 1) for p in parts)]


def surface_counts(text: str) -> dict[str, int]:
    """Counts of ``label=n,...``: at least one, labels differ, none negative."""
    pairs = [(label, int(n)) for label, n in _pairs(text)]
    _distinct([label for label, _ in pairs])
    if not pairs or min(n for _, n in pairs) < 0:
        raise ValueError(f"counts are not negative, and there is one at least: {text!r}")
    return dict(pairs)


def surface_weights(text: str, surfaces: list[str]) -> dict[str, float]:
    """A weight for each surface, 1 where none is given: known labels, none negative, not all zero."""
    given = {label: float(x) for label, x in _pairs(text)}
    unknown = set(given) - set(surfaces)
    found = {s: given.get(s, 1.0) for s in surfaces}
    if unknown or min(found.values(), default=0) < 0 or sum(found.values()) <= 0:
        raise ValueError(f"weights are of known surfaces, not negative and not all zero: {text!r}")
    return found


def surface_list(text: str, known: list[str]) -> list[str]:
    """Known surfaces, each once."""
    found = [p.strip() for p in text.split(",") if p.strip()]
    _distinct(found)
    if set(found) - set(known):
        raise ValueError(f"unknown: {', '.join(sorted(set(found) - set(known)))}")
    return found


def reranking_tasks(selectors: str | Iterable[str]) -> list[tuple[str, str, str]]:
    """Tasks by language (``zh``), ``all``, dataset or leaderboard name; each once, where it is first named."""
    out: dict[str, tuple[str, str, str]] = {}
    for name in [selectors] if isinstance(selectors, str) else selectors:
        found = [t for t in RERANKING_TASKS if name == "all" or name in t[:2] or (name == "zh" and t[2] == name)]
        if not found:
            raise KeyError(f"no such task: {name}")
        out |= {t[0]: t for t in found if t[0] not in out}
    return list(out.values())


def prepared_text(task: Column, role: Column, text: Column, mode: str, whole: dict[str, str], queries: dict[str, str], documents: dict[str, str]) -> Column:
    """``text`` behind its task's instruction: ``coreb_task`` for every text, ``query`` for queries, ``query_doc`` for both kinds, ``none``."""

    def of(table: dict[str, str]) -> Column:
        out = F.lit("")
        for name, instruction in table.items():
            out = F.when(task == name, instruction).otherwise(out)
        return out

    if mode == "coreb_task":
        return F.concat_ws("\n", of(whole), text)
    front = of(queries) if mode in ("query", "query_doc") else F.lit("")
    behind = of(documents) if mode == "query_doc" else F.lit("")
    return F.concat(F.when(role == "query", front).otherwise(behind), text)


def _texts(value: object) -> list[str]:
    """All texts of a value: a text, a record's text fields (else all its values), a list's items in turn."""
    if isinstance(value, dict):
        return [str(value[k]) for k in TEXT_KEYS if value.get(k)] or [str(v) for v in value.values() if v]
    if isinstance(value, list):
        return [t for item in value for t in _texts(item)]
    return [] if value is None or value == "" else [str(value)]


@F.arrow_udf(ArrayType(StringType()))
def text_list(value: pa.Array) -> pa.Array:
    """The texts of a JSON value; a text that is no JSON is itself."""

    def one(v: str | None) -> list[str]:
        try:
            return _texts(json.loads(v)) if v is not None else []
        except ValueError:
            return _texts(v)

    return pa.array([one(v) for v in value.to_pylist()], pa.list_(pa.string()))


def first_text(record: Column, keys: list[str]) -> Column:
    """The first of a JSON record's fields that isn't empty."""
    return F.coalesce(*(F.nullif(F.get_json_object(record, f"$.{k}"), F.lit("")) for k in keys))


def math_prompt(examples: Column, question: Column, template: str = "plain") -> Column:
    """A prompt with worked examples (an array of question and answer) before the question; ``boxed`` and ``bare`` are other forms."""
    if template == "bare":
        return question
    if template == "boxed":

        def example(e: Column) -> Column:
            reasoning = F.when(F.contains(e["answer"], F.lit("####")), F.trim(F.regexp_replace(e["answer"], "(?s)####(?!.*####).*$", ""))).otherwise(F.trim(e["answer"]))
            final = F.trim(F.substring_index(e["answer"], "####", -1))
            return F.concat(e["question"], F.lit("\n\nReasoning:\n"), reasoning, F.lit("\n\nANSWER: \\boxed{"), final, F.lit("}"))

        return F.concat_ws("\n\n", F.lit(BOXED_PROMPT), F.array_join(F.transform(examples, example), "\n\n"), question, F.lit(BOXED_LAST))
    shown = F.transform(examples, lambda e: F.concat(F.lit("Question: "), e["question"], F.lit("\nAnswer: "), e["answer"], F.lit("\n")))
    last = F.concat(F.lit("Question: "), question, F.lit("\nAnswer: Let's think step by step."))
    return F.array_join(F.concat(F.array(F.lit(MATH_PROMPT), F.lit("")), shown, F.array(last)), "\n")


def rounded_json(value: Column, *scores: str) -> Column:
    """A struct as JSON with its score fields to four places, nulls kept."""
    for name in scores:
        value = value.withField(name, F.bround(value[name], 4))
    return F.to_json(value, {"ignoreNullFields": "false"})
