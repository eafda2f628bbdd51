from __future__ import annotations

import random

import pytest

#: Columns that documents may have besides, named like some that the operators use.
CLASHING = "n long, node long, _id long, salt int, score double, keep_id long, id string, row long, missing string"


def frame(spark, rows, columns="doc_id long, text string"):
    """rows with CLASHING columns after them."""
    extra = (1, 2, 3, 4, 0.5, 6, "x", 8, "y")
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{columns}, {CLASHING}")


def sentence(rng: random.Random, words: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def odd_documents(seed: int = 3) -> list[tuple[int | None, str | None]]:
    """Null ids and texts, empty and blank texts, a very long one, copies, near copies, repeated rows."""
    rng = random.Random(seed)
    base = sentence(rng, 120)
    rows = [(i, sentence(rng, rng.randrange(1, 90))) for i in range(10, 40)]
    rows += [(i, base) for i in range(50, 62)]
    for i in range(70, 82):
        words = base.split()
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    return rows + [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (6, "one two three"),
        (7, "É one two 東京 🙂 three four five"), (8, sentence(rng, 20_000)), (9, "a b " * 3000),
        (None, "no id"), (None, None), (90, base + "\n"), (91, "  " + base.replace(" ", "\n")),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_documents())


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])
