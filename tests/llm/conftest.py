import random

import pytest


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text, lang, source, n_chars, and columns with clashing names) with nulls, empty, long, repeated rows."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    long = " ".join(word() for _ in range(30_000))
    plain = " ".join(word() for _ in range(60))
    near = plain.split()
    near[7] = "changed"
    texts = [None, "", " ", "\n\t ", plain, plain, " ".join(near), long, long + " x", "é ü ß", "one", plain.replace(" ", "  \n")]
    rows = [(i, t, None if i % 2 else "en", None if i % 3 == 0 else f"s{i % 3}", None, i, "x", 7, "text") for i, t in enumerate(texts)]
    rows += [(4, plain, "en", "s1", 3, 1, "x", 7, "t"), (None, plain, None, None, None, None, None, None, None), (4, "another text here", "en", "s1", 3, 1, "x", 7, "t")]
    return rows, "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, key int, rid string"


@pytest.fixture
def odd(spark, awkward):
    return spark.createDataFrame(*awkward)


@pytest.fixture
def none(spark, awkward):
    return spark.createDataFrame([], awkward[1])
