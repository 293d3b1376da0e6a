import pytest

ODD = [None, "", "   \n\t ", "word", "x" * 200_000, "é ü 漢字 \U0001f600 " * 500, "a b c\n" * 3000, "a b c\n" * 3000]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and texts, columns whose names clash."""
    rows = [(k, t, "en", None if k % 2 else "s") for k, t in enumerate(ODD)] + [(3, "word", "en", "s"), (3, "word", "en", "s"), (None, "no id", None, None)]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    clash = {c: df["lang"] for c in ("fp", "component_id", "size", "k", "n_words", "rule", "_text", "h", "seq", "a", "block")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
