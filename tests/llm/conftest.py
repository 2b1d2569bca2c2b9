"""Rows that every operator on documents must bear."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, `range` string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and very long texts, repeated rows, copies, and columns named as the operators' own."""
    long = "the quick brown fox jumps over a lazy dog. " * 30_000
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "word", "en"), (5, long, "en"), (None, "a null id here.", None),
        (None, None, None), (6, "same text here, as said.", "en"), (7, "same text here, as said.", "en"), (6, "same text here, as said.", "en"),
        (8, "x" * 200_000, None), (9, "1" * 100_000, None), (10, "🙂 ſtrange İ \x00   text  with   spaces \n\n and ▁ marks ", "fr"),
        (11, "</s><|turn|>", None), (12, "你好 世界", "zh"), (13, "12345 67890", None), (14, "@" * 5000 + "a@b.c", None), (15, "é" * 3000 + " +1 (212) 555-0123", None),
        (16, "0" * 4500 + ".1.1.1", None), (17, "ends <|endoftext|> here<|endoftext|>", None),
    ]
    return spark.createDataFrame([(i, t, lang, "src", None if t is None else len(t), "k", "s", "r") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
