"""Code completions of language models, cut down to what a test can run after a function's head."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What ends a completion, what ends thoughts, what fences code.
ENDS = ("\n#", "\nif __name__", "\nprint(")
THOUGHT_END, FENCE, LANGUAGE = "</think>", "```", "python"
INDENT = "    "


def _depth(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _blocks(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of lines: each starts at an unindented line and goes on to the next one."""
    starts = [i for i, line in enumerate(lines) if line.strip() and not _depth(line)]
    yield from zip(starts, [*starts[1:], len(lines)])


def _code(text: str) -> str:
    """What follows the last thought; the first fenced part where there is one."""
    parts = text.replace("\r\n", "\n").rpartition(THOUGHT_END)[2].split(FENCE)
    if len(parts) < 3:
        return FENCE.join(parts)
    return parts[1].lstrip().removeprefix(LANGUAGE) if parts[1].lstrip().startswith(LANGUAGE) else parts[1]


def _body(code: str, name: str) -> str | None:
    """The body of the function of this name, with the imports, functions and classes beside it behind; None where it has none."""
    lines = code.splitlines()
    head = re.compile(rf"\s*def\s+{re.escape(name)}\s*\(")
    at = next((i for i, line in enumerate(lines) if head.match(line)), None)
    if at is None:
        return None
    depth = len(lines[at]) - len(lines[at].lstrip())
    end = next((i for i in range(at + 1, len(lines)) if lines[i].strip() and _depth(lines[i]) <= depth), len(lines))
    body = "\n".join(lines[at + 1 : end]).strip("\n").split("\n")
    while body and not body[0].strip():
        body = body[1:]
    if not body:
        return None
    least = min(_depth(line) for line in body if line.strip())
    shown = "\n".join(INDENT + line[least:] if line.strip() else line for line in body).rstrip()
    beside = []
    for lo, hi in _blocks(lines):
        line = lines[lo].strip()
        if at <= lo < end or head.match(line):
            continue
        if line.startswith(("import ", "from ")):
            beside.append(lines[lo])
        elif line.startswith(("def ", "class ")):
            beside += lines[lo : min(hi, at) if lo < at < hi else hi]
    return "\n".join([shown, *beside]).rstrip() + "\n"


def clean_completion(text: str | None, name: str | None = None) -> str | None:
    """The runnable part of a completion: the named function's body, else the text up to what ends it, indented as a body where it isn't code of its own."""
    if text is None:
        return None
    code = _code(text)
    if name and (body := _body(code, name)):
        return body
    code = code[: min([i for end in ENDS if (i := code.find(end)) >= 0], default=len(code))]
    first = next((line for line in code.splitlines() if line.strip()), "")
    if first and not first.startswith((" ", "\t", "def ", "class ")):
        code = "\n".join(INDENT + line if line.strip() else line for line in code.splitlines())
    return code.rstrip() + "\n"


@F.arrow_udf(StringType())
def cleaned(text: pa.Array, name: pa.Array) -> pa.Array:
    """``clean_completion`` of a column."""
    return pa.array([clean_completion(t, n) for t, n in zip(text.to_pylist(), name.to_pylist())], pa.string())
