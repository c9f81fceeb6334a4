from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, block string, n int, shard string, rank int, score string, kept boolean"


def rows_of(texts: list, first: int = 0) -> list[tuple]:
    """Rows with the columns of documents and others whose names operators use themselves."""
    return [(first + i, t, ("en", "de", None)[i % 3], None if i % 5 == 0 else f"s{i % 2}", None if t is None else len(t), i, "b", i, None, 7, "x", None) for i, t in enumerate(texts)]


ODD = [None, "", "   \n\t", "one", "### $$$", "naïve café Ünïcode 漢字 текст", "a b c d e f g h i j k l m n o p", "<|endoftext|> it's  fine", "x" * 5000, "same text here for two", "same text here for two", "\x00 zero \x1f unit"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and odd texts, copies, a repeated row, a null id, one very long text."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(30_000))
    rows = rows_of([*ODD, long])
    rows += [rows[9], (None, "a row without an id", None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def copied_docs(spark):
    """Random texts with exact copies, near copies and shared passages; a third of all rows is one text."""
    rng = random.Random(11)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(400)}"
    texts, passage, hot = [], [word() for _ in range(30)], " ".join(word() for _ in range(40))
    for i in range(120):
        base = [word() for _ in range(rng.randrange(5, 160))]
        if i % 4 == 0:
            at = rng.randrange(len(base))
            base[at:at] = passage[: rng.randrange(8, 31)]
        texts.append(" ".join(base))
        if i % 6 == 0:
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
        if i % 9 == 0:
            texts.append(" ".join(base))
    texts += [hot] * (len(texts) // 2)
    rng.shuffle(texts)
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(5)
