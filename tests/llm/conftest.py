import pytest
from pyspark.sql import functions as F

CLASHES = ["key", "tid", "fp", "size", "place", "host", "n", "part", "label", "rest", "_bucket", "_measure", "_host", "_place",
           "_clean", "_n", "_id", "_hash", "_whole", "_cut", "fingerprint", "component_id", "kept", "copies"]


def prose(seed: int, words: int, vocabulary: int = 4000) -> str:
    """Made-up sentences; the same seed gives the same text."""
    import random

    rng = random.Random(seed)
    parts = ["ta", "ren", "mo", "li", "sha", "ver", "qu", "on", "est", "ing", "ä", "ción"]
    names = ["".join(parts[(i // 12**k + k) % 12] for k in range(2 + i % 3)) for i in range(vocabulary)]
    out = [rng.choice(names) + ("." if i % 9 == 8 else "") for i in range(words)]
    return " ".join(out)


def documents(spark, rows, clashes: bool = False):
    """The table of documents from (doc_id, text, source); with clashes, extra columns named like internal ones."""
    df = spark.createDataFrame(
        [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows],
        "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)]) if clashes else df


ODD = [
    (None, None, None), (None, "", None), (1, None, "s"), (2, "", "s"), (3, " \n\t ", "t"), (4, "one", "t"),
    (5, prose(5, 300), "s"), (5, prose(5, 300), "s"), (5, prose(6, 40), "s"), (6, prose(5, 300), "u"),
    (7, prose(7, 60_000), "u"), (8, "x" * 200_000, "u"), (9, "漢字 " * 400, None), (10, "a b c\n" * 200, "s"),
    (None, prose(11, 80), "t"), (-3, prose(12, 80), "t")]


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD, clashes=True).cache()


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])
