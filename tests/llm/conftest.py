from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, th string, words string, block int, root long, key string, score double, hit_id long, text2 string, `a.b` int"


def rows_of(texts, first=0):
    """Documents with columns that clash with names inside the operators."""
    return [(i, t, "en" if i is None or i % 2 else None, f"src{(i or 0) % 3}", len(t or ""), 1, "th", "w", 2, 3, "k", 0.5, 4, "x", 7) for i, t in texts]


@pytest.fixture(scope="session")
def odd_texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeiouklmnrst") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(120), prose(40)
    near = base.split()
    near[60] = "changed"
    long = prose(30000)
    return [
        (0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "one two"), (None, base), (8, prose(50) + " " + passage + " " + prose(50)),
        (9, prose(20) + "\n" + passage.replace(" ", "\n") + "\n" + prose(9)), (10, long), (10, long), (11, "É ß 漢字 emoji 😀 don't stop 12 ''s"), (12, " ".join(["ha"] * 200)), (None, None), (13, prose(300)),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    return spark.createDataFrame(rows_of(odd_texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
