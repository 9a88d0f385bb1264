import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, kept string, size string, bucket string"
LONG = "lorem ipsum dolor " * 4000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and very long texts, repeated rows, and columns whose names clash."""
    texts = [
        (1, "The cat sat on the mat and looked at the dog by the door", "en", "a"),
        (2, "The cat sat on the mat and looked at the dog by the door", "en", "a"),
        (2, "The cat sat on the mat and looked at the dog by the door", "en", "a"),
        (3, "Der Hund lag vor der Tür und schlief den ganzen langen Tag", "de", None),
        (4, None, "en", "b"),
        (5, "", None, None),
        (6, " \t\n\x0b ", "de", "b"),
        (7, LONG, "en", "b"),
        (None, "A text without an id that still has some words in it", "en", None),
        (8, "12 34 -- !!", "en", "c"),
        (9, "Nur das", "de", "c"),
        (10, "x" * 5000, None, "c"),
    ]
    return spark.createDataFrame([(*t, len(t[1] or ""), 1, "x", "y", "z") for t in texts], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
