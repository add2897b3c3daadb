import pytest

LONG = "wort " * 40_000


@pytest.fixture(scope="session")
def tables(spark, data):
    return {t: spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "pages", "benchmark")}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, LONG), (6, "one"), (6, "one"), (7, "123 !!"),
            (None, "one two three four"), (None, None), (8, "one two three four")]
    return spark.createDataFrame([(i, t, None, None, 9, "k", 0.5, "x") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, key string, "
                                 "score double, bytes string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
