import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, cls long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows and ids, multi-byte text."""
    rng = random.Random(3)
    words = ["the", "of", "tion", "é", "zu", "Anth", "sher", "blend"] + ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    base = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(4)]
    rows = [(None, None), (None, "no id here at all"), (0, ""), (1, None), (2, " \t\n"), (3, "ab"), (3, "ab"), (4, "z" * 20_000), (5, "one two three four"), (6, "One TWO three four")]
    for i in range(7, 60):
        t = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    full = [(i, t, None if i is None or i % 5 == 0 else ("en", "de")[i % 2], None if i is None or i % 7 == 0 else f"s{i % 3}", None, "k", 1, 2) for i, t in odd_rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
