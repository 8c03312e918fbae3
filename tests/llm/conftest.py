import pytest

TEXTS = [None, "", " \n\t", "a", "word", "one two", "one two three", "one two three", "One  TWO\nthree", "é ß 漢字 🙂", "\x01odd\x1c", "<|endoftext|> x", "x" * 5000, "the same words again and again " * 40]


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, a repeated id with another text, and columns with clashing names."""
    rows = [(i, t, "en", i) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", 5), (3, "another text", None, None), (None, "no id", None, None)]
    names = "doc_id long, text string, score string, h long, fp string, key string, cell int, kept boolean, target int, words string"
    return spark.createDataFrame([(i, t, s, h, "x", "k", 1, True, 0, "w") for i, t, s, h in rows], names)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
