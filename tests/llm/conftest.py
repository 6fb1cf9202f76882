import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long_text = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, "one two three four", "en", "a", 18),
        (1, "one two three four", "en", "a", 18),
        (2, "One TWO three four", None, None, None),
        (3, None, "en", "a", None),
        (4, "", None, "b", 0),
        (5, " \n\t ", "fr", "b", 4),
        (None, "one two three four", "en", "a", 18),
        (None, None, None, None, None),
        (6, long_text, "en", "a", len(long_text)),
        (7, "x" * 300_000, "en", "a", 300_000),
        (8, "a.b" * 30_000 + "@" + "c.d" * 30_000, "en", "a", 3),
        (9, "1" * 8_000 + " " + "+1 " * 1000, "de", "a", 3),
        (-3, "été  à Paris\x1cß 12", "fr", "c", 5),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clashing = "key group shard slot kind start end score ids offset fp u v n items row_id now first salt".split()
    return df.selectExpr("*", *[f"'{c}' AS `{c}`" for c in clashing])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
