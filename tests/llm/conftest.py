import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
# ids repeat and are null, texts are null, empty, blank, long, and tie; other columns clash with names used inside
ROWS = [
    (1, "one two three four five six seven", "x"), (2, "one two three four five six seven", None), (3, None, "x"), (4, "", "y"), (5, " \t\n ", None), (None, "a null id", None), (7, LONG, "z"),
    (8, "one  two three\tfour five six seven", "x"), (9, "a\nb\nc\na\nb\nc\nd", "x"), (9, "a\nb\nc\na\nb\nc\nd", "x"), (10, "naïve 漢字 😀 it's <|endoftext|> 12a", "x"), (12, "x\ny\na\nb\nc\nz", "x"),
]
SCHEMA = "doc_id long, text string, id string, key int, fp long, n int, node int, gone int, keep_id int"


def rows_of(docs):
    return [(d, t, x, 1, 2, 3, 4, 5, 6) for d, t, x in docs]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every kind of odd row and clashing columns."""
    return spark.createDataFrame(rows_of(ROWS), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest documents table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
