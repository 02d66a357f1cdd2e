import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty texts, ties, repeated rows, a very long text, and extra columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(12_000))
    rows = [
        (1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "", 0),
        (4, " \n\t ", "en", "s", 4), (None, "x y z", "en", "s", 5), (None, None, "en", None, 0), (5, long, "en", "s", len(long)),
        (6, "A  B C é▁\n\nzz", "fr", "t", 5), (7, long, "en", "t", len(long)), (8, "q" * 40_000, "xx", "u", 40_000),
    ]
    flat = [(*r, 1, "k", "w", "n", "h") for r in rows]
    return spark.createDataFrame(flat, KIND + ", n_words int, key string, w string, n string, h string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KIND)
