import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, size int, node string, _key string, _row string, spans string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéñ中") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): nulls, blanks, ties, copies, a long text, shared passages, texts of odd bytes."""
    rng = random.Random(4)
    passage, other = prose(rng, 60), prose(rng, 90)
    near = prose(rng, 200).split()
    texts = [None, "", " \t\n\x0b\x0c\r", "one", "one two three four", "x" * 5000, "ab " * 3000, "line\n" * 40, "é" * 300, "\x00\x01 ▁ \U0001f600  "]
    texts += [passage, passage, f"{prose(rng, 30)} {passage} {prose(rng, 30)}", f"{other}\n{other}", other, prose(rng, 3000)]
    texts += [" ".join(w if i % 97 != k else "changed" for i, w in enumerate(near)) for k in range(6)]
    texts += [f"start{k} {passage} end{k}" for k in range(12)]
    texts += [prose(rng, rng.randint(1, 120)) for _ in range(30)]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 11 == 0 else f"s{i % 5}") for i, t in enumerate(texts)]
    return [*rows, (10_000, "one", "en", "s1"), (10_000, "one", "en", "s1"), (None, passage, "en", "s2"), (None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The same with extra columns, some with names that operators use."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "h", 1, None, "k", "r", "s") for r in odd_rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
