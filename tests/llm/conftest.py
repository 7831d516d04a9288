import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, rep int, h string, comp long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Random texts, exact copies, near copies of several degrees, and the odd rows."""
    rng = random.Random(3)
    texts = [words(rng, rng.choice([1, 2, 3, 8, 40, 120])) for _ in range(60)]
    for i in range(40):
        base = texts[rng.randrange(60)].split()
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            base[rng.randrange(len(base))] = f"x{rng.randrange(99)}"
        texts.append(" ".join(base).upper() if i % 7 == 0 else " ".join(base))
    texts += ["", None, " \n\t ", "one", "ONE", "one two", "é\u00a0ü é", "a" * 50_000, "\n".join(["same line here"] * 900)]
    return [(i * 3, t, None if i % 11 == 0 else "en", None if i % 13 == 0 else f"s{i % 5}") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, la, s, len(t or ""), 1, "x", 5) for i, t, la, s in corpus]
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
