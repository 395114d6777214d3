import pytest

ODD = [
    (1, "Hello hello world, the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (1, "Hello hello world, the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "some text without an id", "en", "b", 3),
    (4, "   \n\t ", "fr", None, 6),
    (5, "x" * 300_000, "de", "a", 300_000),
    (6, "word " * 60_000, "de", "a", 300_000),
    (7, "Ünï çödé 漢字 🙂   \x00 end", None, "b", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names the operators use themselves."""
    extra = ["id", "fp", "score", "kept", "log_weight", "items", "spans", "root", "node", "bucket", "__text", "__of", "similarity"]
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in extra:
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id > 99")
