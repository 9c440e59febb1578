import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case, and extra columns whose names clash with inner ones."""
    words = " ".join(f"word{k % 977}" for k in range(20_000))
    rows = [
        (1, "A short text.", "en", "s", 13), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "  \n\t ", "en", "s", 5),
        (5, words, "en", "s", len(words)), (6, words, None, "s", None), (7, "A short text.", "en", "s", 13), (7, "A short text.", "en", "s", 13),
        (8, "é▁ü 漢字 \x00 <s> & 😀\r\nend", "de", None, 20), (None, "no id at all", "en", "s", 12), (9, "12345 67", "fr", "s", 8),
        (10, "x" * 5000, "en", "s", 5000),
    ]
    own = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    clash = ["node", "key", "fp", "score", "before", "row", "one", "shard", "label", "component_id", "digest", "item_id", "rank", "i", "held_out", "_part"]
    return own.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
