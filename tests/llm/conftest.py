import pytest

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "a", "A b", "Under the MIT License\n\nx", "the same text of six words here", "the same text of six words here", "é ü ▁ x  y\tz\x00q \n w ", " lead", "x" * 30_000, "1 2 3 4 5 6 7 8 9 " * 400, "日本語 テキスト     naïve <|endoftext|> it's </s> <s>"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, repeated and long texts, and columns whose names clash with results'."""
    rows = [(i, t, None if i % 5 == 4 else ("en", "fr", "de", "es")[i % 4], None if i == 3 else f"s{i % 2}", len(t or ""), i, "x") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id at all", "en", "s0", 12, 1, "y"), (2, "a", "en", "s0", 1, 1, "y"), (2, "a", "en", "s0", 1, 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, length long, score string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
