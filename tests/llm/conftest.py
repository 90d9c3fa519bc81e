import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, size string, chunk int, key int, fp int, shard int, copies int, index int, doc int, quality int, m int, id int, slot int, target int"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    syllables = ["ba", "do", "ki", "lu", "me", "no", "pa", "ri", "so", "tu", "ve", "xo"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(400)]


@pytest.fixture(scope="session")
def text_of(words):
    return lambda seed, n: " ".join(random.Random(seed).choices(words, k=n))


@pytest.fixture(scope="session")
def odd_rows(text_of):
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    base = text_of(1, 60)
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \t\n\x0b\x0c\r ", "de", "b"), (None, base + " tail", "de", None), (None, None, "en", "c"),
        (6, text_of(2, 30_000), "de", "a"), (7, "Été Straße 日本語 ÀÉ x y", "fr", "a"), (8, "word", None, "a"), (9, "a b c d", "en", "a"), (10, "\n\n" + base + "\n" + base + "\n\nend", "en", "c"), (-5, "x" * 50_000, "en", "c"),
        (11, base.upper(), "en", "a"), (12, "### *** $$$ %%% " * 40, "en", "a"), (13, "123 456 ! ?", "en", "a"),
    ]
    return [(d, t, lang, s, None if t is None else len(t)) + (1, "x") + (None,) * 12 for d, t, lang, s in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, odd_rows):
    return spark.createDataFrame([(d, int(d % 2), 0, "extra") for d, *_ in odd_rows if d is not None] + [(None, 1, 0, "x"), (4, None, None, None)], "doc_id long, quality int, toxic int, text string")
