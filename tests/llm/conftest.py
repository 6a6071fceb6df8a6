import pytest

#: Null id, null and blank texts, repeated rows, ties, a very long text, and columns whose names clash with results.
ROWS = [
    (1, "the cat sat on the mat and looked at the dog", "en", "a"),
    (2, "The Cat sat on the mat and looked at the dog", "en", "a"),
    (2, "The Cat sat on the mat and looked at the dog", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n", "en", None),
    (None, "le chat est sur la table avec le chien", "fr", "b"),
    (7, "le chat est sur la table avec le chien", "fr", "b"),
    (8, "word " * 60_000, "en", "c"),
    (9, "éàü ß İ 😀 <|endoftext|> x y", None, "c"),
    (10, "12345 !!! ???", "en", "c"),
    (11, "one", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = ("id", "fp", "component", "shard", "slot", "size", "score", "kept", "n_words", "bound", "taken", "_n", "part")


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
