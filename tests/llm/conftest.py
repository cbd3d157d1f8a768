import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns that clash."""
    rows = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \t\n ", "en", "a", 4), (None, "some text here", "en", "a", 14), (4, "same text, twice over", "en", "b", 21),
        (4, "same text, twice over", "en", "b", 21), (5, "same  text,\ntwice over", "fr", "b", 22), (6, "word " * 60_000, "fr", None, 300_000), (7, "éà ü 日本 \U0001f600 ½", None, "c", 12),
        (8, "line one\nline one\n\nline two\n", "en", "c", 28),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for clash in ("hash", "norm", "fp", "node", "key", "size", "words", "kept", "id", "label", "rep", "doc", "place", "order", "bucket", "n_lines", "kept_id", "found", "cleaned", "row", "gone", "mix_id", "mix_pass", "spread", "part", "__x"):
        df = df.selectExpr("*", f"'x' as {clash}")
    return df.selectExpr("*", "'x' as `a.b`")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
