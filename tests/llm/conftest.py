import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    base = " ".join(f"word{i}" for i in range(120))
    rows = [
        (1, base, "en", "s1"), (2, base, "en", "s1"), (3, base.upper().replace("WORD", "Word"), "en", "s2"), (4, base + " tail", "en", "s1"), (5, base.replace("word7 ", "wird7 "), None, "s2"),
        (6, None, None, None), (7, "", "en", None), (8, " \t\n", "en", "s1"), (9, "É É", "fr", "s3"), (10, "é é", "fr", "s3"),
        (11, "mail a.b@c.org or 1.2.3.4 and +1 (555) 123-4567", "en", "s2"), (12, "x" * 70000, "en", "s2"), (13, "the quick brown fox " * 4000, "en", "s1"),
        (14, "a  b ▁ c\n\nd e 🙂  ", "en", "s1"), (15, "one", "en", "s3"), (16, "one two", "en", "s3"),
    ]
    rows += [(100 + i, f"copy of the same old text number {i % 3}", "en", "s1") for i in range(30)]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def rows():
    return _rows()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, and extra columns that clash with names the operators use."""
    rows = [(None, "a b c", "x", 1, 1), (None, "a b c", "x", 1, 1), (5, "a b c", None, 2, 2), (5, "a b c", None, 2, 2), (6, None, None, None, None), (7, "A b C", "y", 0, 0)]
    more = ("at_id", "times", "copy", "_id", "_n", "_i", "block", "number", "body", "ids", "unit", "row", "h", "score", "toxic", "size", "taken", "root", "first", "kept", "order")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, fp long, votes long")
    return df.withColumns({c: F.lit(c) for c in more})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
