import pytest

LONG = "word " * 30_000 + "end"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash with results."""
    rows = [
        (1, "the cat sat on the mat and looked at the dog"),
        (2, "the cat sat on the mat and looked at the dog"),
        (2, "the cat sat on the mat and looked at the dog"),
        (3, None),
        (4, ""),
        (5, " \t\n"),
        (6, "Ünïcödé ▁ 漢字 <|endoftext|> — it's"),
        (7, LONG),
        (None, "no id here"),
        (8, "x"),
    ]
    schema = "doc_id long, text string, lang string, id long, print string, fingerprint string, hit_words string, pieces string, decoded int"
    return spark.createDataFrame([(i, t, "en" if t else None, 0, "p", "f", "h", "s", 1) for i, t in rows], schema)
