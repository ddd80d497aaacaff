import pytest
from pyspark.sql import functions as F

from sparkrecon.llm.common import importable

#: Nulls, empty and blank texts, case pairs, repeated rows, one id with two texts, no
#: blanks at all, many signs.
EDGE = [
    (1, "One two three four five six seven eight nine ten."),
    (2, "ONE two three four five six seven eight nine ten."),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "one two"),
    (7, "one two"),
    (7, "one two"),
    (8, "Größe é́ naïve 中文 emoji 😀😀 it's 12345 --- …"),
    (9, "x" * 3000),
    (10, "a@b.example.com, +1 (555) 123-4567; 10.0.0.1 and 4539 1488 0343 6467."),
    (None, "a text without an id that is long enough"),
    (None, None),
    (11, "word " * 4000),
]


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    importable(spark)


@pytest.fixture(scope="session")
def edge(spark):
    """The rows above, with columns named like inner ones of the operators."""
    docs = spark.createDataFrame(EDGE, "doc_id long, text string")
    names = ["digest", "node", "score", "part", "kind", "spans", "size", "_text", "row", "tokens"]
    return docs.withColumns({name: F.lit("mine") for name in names})


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")
