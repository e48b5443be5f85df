import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    draw = random.Random(seed)
    return [f"w{draw.randint(0, vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, blank and very long texts, copies, near copies and repeated rows."""
    base = prose(1, 300)
    near = [*base[:150], "other", *base[151:]]
    far = prose(2, 300)
    long = prose(3, 60_000, 20_000)
    rows = [
        (1, " ".join(base), "en", "a"), (2, " ".join(near), "en", "a"), (3, " ".join(base).upper(), "en", "b"),
        (4, " ".join(far), "en", None), (5, None, "en", "a"), (6, "", None, "a"), (7, " \t\n ", "en", "b"),
        (8, "one two three", "en", "b"), (9, "One  two\nthree", "en", "b"), (10, "one two", None, None),
        (11, " ".join(long), "en", "a"), (12, " ".join(long[:-50]), "en", "a"), (13, " ".join(far), "en", None),
        (14, "a b c d e", "en", "b"), (15, "a b c d e", "en", "b"), (None, " ".join(far), "en", "a"),
        (16, "é" * 5000, "fr", "c"), (17, "\n".join(["same line of words again"] * 40), "en", "a"),
        (1, " ".join(base), "en", "a"), (18, "x" * 2_000_000 + " tail", "de", "c"), (19, "\\ <|end|> #*$ | %", "en", "a"),
    ]
    return spark.createDataFrame([(i, t, lang, source, None) for i, t, lang, source in rows], DOCUMENTS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def near_family(spark):
    """Many variants of one text, at all distances, among unrelated texts."""
    draw = random.Random(5)
    base = prose(7, 120)
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(draw.randint(0, 14)):
            text[draw.randrange(len(text))] = f"v{draw.randint(0, 9)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(prose(100 + i, draw.randint(1, 60)))) for i in range(200)]
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCUMENTS)
