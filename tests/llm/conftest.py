import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, shard string"


@pytest.fixture(scope="session")
def rows():
    """Awkward documents: nulls, empties, ties, repeated rows, a long text."""
    base = [
        (1, "Hello  wide world of words"),
        (2, "Hello wide world of words"),
        (3, "Hello wide worldof words"),
        (4, ""),
        (5, None),
        (6, " \n\t "),
        (7, "tie"),
        (8, "tie"),
        (8, "tie"),
        (None, "tie"),
        (None, None),
        (9, "long " * 30_000),
        (10, "naïve café 😀 déjà vu\u00a0nbsp"),
        (11, "\u0663\u0664 123 --- !!!"),
    ]
    return [(i, t, "en", "s", None if t is None else len(t), "x", "y", "z") for i, t in base]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
