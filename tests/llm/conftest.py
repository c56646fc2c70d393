import random

import pytest

CLASHING = "words string, node long, digest string, size long, n_words long, held_out boolean, label int, band long, kept boolean"


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Documents with every odd case: nulls, empty and very long texts, repeated rows, near copies, shared passages."""
    rng = random.Random(7)
    base, passage = sentence(rng, 80), sentence(rng, 70)
    near = base.split()
    near[40] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (3, " ".join(near), "en", "b"),
        (4, None, "en", "a"), (5, "", "en", None), (6, " \n\t ", None, "b"), (7, "Two words", "de", "b"), (8, "two WORDS", "de", "b"),
        (9, sentence(rng, 30) + " " + passage, "fr", "c"), (10, passage + "\n" + sentence(rng, 30), "fr", "c"),
        (11, "ab" * 300, "en", "a"), (12, "line one is here\n" * 12 + "x" * 60, "en", "a"),
        (13, sentence(rng, 30_000, 5000), "es", "c"), (14, "Élan déjà-vu ñandú 日本語 it's <|endoftext|> 12 & co.", "es", None),
    ]
    rows += [(20 + i, sentence(rng, rng.randrange(12, 60)), rng.choice(["en", "de"]), rng.choice("abc")) for i in range(40)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with further columns whose names the operators use themselves."""
    names = [c.split()[0] for c in CLASHING.split(", ")]
    values = ("x", 1, "y", 2, 3, True, 1, 5, False)
    rows = [(d, t, lang, s, None, *values) for d, t, lang, s in edge_rows]
    assert len(names) == len(values)
    return spark.createDataFrame(rows, f"{SCHEMA}, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
