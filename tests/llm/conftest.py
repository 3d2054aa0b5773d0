"""Inputs that all operators must take."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, word int, key double, component_id string, u string, label string"


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}é" for _ in range(n)]


def lines_of(tokens: list[str], per_line: int = 8) -> str:
    return "\n".join(" ".join(tokens[k : k + per_line]) for k in range(0, len(tokens), per_line))


def tricky_rows() -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, copies, near copies, repeated rows, hot lines, one very long text."""
    rng = random.Random(5)
    base = words(rng, 240)
    near = base.copy()
    near[100] = "changed"
    passage = words(rng, 70)
    long = words(rng, 60_000)
    rows = [
        (None, None), (None, "no id " + lines_of(base)), (None, ""), (1, None), (2, ""), (3, " \t\n \x0b"), (4, "one"), (5, "one two three four"), (6, "ONE two three four"),
        (10, lines_of(base)), (11, lines_of(base)), (12, lines_of(near)), (13, lines_of(base).upper()), (13, lines_of(base).upper()), (14, lines_of(words(rng, 30) + passage + words(rng, 30))),
        (15, " ".join(passage + words(rng, 90))), (16, lines_of(words(rng, 20) + passage)), (17, lines_of(words(rng, 100))), (17, lines_of(words(rng, 100))), (18, lines_of(long)), (19, lines_of(long[:30_000] + base)),
        (20, "same same same " * 60), (21, "same same same " * 60), (22, "a\n\n\na\nb b b\nb b b"), (23, " x y\x00z ퟿ \U0001f600 mail me@example.com"), (-7, lines_of(passage)),
    ]
    rows += [(100 + k, f"Terms of use: all rights of this page are reserved by its makers, who may change them any day\n{' '.join(words(rng, 40))}") for k in range(130)]
    return rows


@pytest.fixture(scope="session")
def tricky(spark):
    rows = [(i, t, None if k % 3 else "en", None, None, "clash", k, 0.5, "c", "u", None) for k, (i, t) in enumerate(tricky_rows())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
