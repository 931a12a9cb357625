import pytest

TEXTS = [
    (1, "The cat sat on the mat and looked at the moon over the quiet hills tonight."),
    (2, "The cat  sat\ton the mat and looked at the moon over the quiet hills tonight."),
    (3, None), (4, ""), (5, " \n\t "), (6, "one"), (None, "a row without an id"), (None, None),
    (7, "Call +1 (555) 010-9999 or mail a.b@mail.example.com now, card 4111 1111 1111 1111 at 10.0.0.256 10.0.0.1"),
    (8, "word " * 3000 + "end"), (8, "word " * 3000 + "end"), (9, "x" * 20000),
    (10, "the cat sat on the mat and looked at the moon over the quiet hills tonight."),
    (11, "héllo wörld 你好 \U0001f600 <|endoftext|> café"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, very long and repeated rows, null ids, and columns whose names
    clash with helper columns."""
    rows = [(i, t, "k", 7, "n", 0.5) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, doc int, regions string, keep double")


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
