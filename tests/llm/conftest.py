import pytest

from panelcraft.llm.shipping import ship_package

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf(spark):
    ship_package(spark)
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf):
    """(doc_id, text) of the smallest documents table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


DOC = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and blank texts, repeated rows and ids, ties, marks and other scripts, a long run.
ODD_TEXTS = [
    None,
    "",
    "   \n",
    "one two three",
    "One TWO three",
    "a b c d e f g h i j k l",
    "a b c d e f g h i j k l",
    "日本語 текст ß É 😀 😀",
    "<|endoftext|> \\### Assistant: </turn>",
    "x" * 50_000,
    "7 " * 20_000,
    "9" * 30_000,
    "a@b." + "c." * 20_000 + "d",
]


@pytest.fixture(scope="session")
def odd(spark, sf):
    """The odd texts as documents; the last rows repeat an id and have a null one."""
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, "one two three", "en", "s", 1), (None, "no id at all here", None, None, None)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def empty(spark, sf):
    return spark.createDataFrame([], DOC)
