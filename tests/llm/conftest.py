import pytest

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, repeats and clashing names."""
    rows = [
        (1, None, "en", "s", 0, "a"), (2, "", None, "s", 0, "b"), (3, " \n\t \n", "xx", None, None, None), (4, LONG, "en", "s", 1, "c"), (5, LONG, "en", "s", 1, "c"), (6, "one", "en", "s", 1, "c"),
        (None, "a null id", "en", "s", 1, "c"), (7, "repeated row", "en", "s", 1, "c"), (7, "repeated row", "en", "s", 1, "c"), (8, "ÉCOLE élève 日本語 😀  x\x1cy <|endoftext|> ▁z", "fr", "s", 1, "c"), (9, "one", None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Score string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
