"""Tables that several test modules of the corpus operators use."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, score double, n_lines string"


def docs_table(spark, texts, ids=None):
    """Texts with ids from 0, and columns whose names operators might use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, "x", 1.0, "y") for i, t in zip(ids, texts)], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return lambda texts, ids=None: docs_table(spark, texts, ids)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, white space, very long texts, a very long word, repeated rows and ids."""
    texts = [None, "", " \n\t ", "one", "two words", "a b c d e f", "word " * 60000, "same text again " * 50, "same text again " * 50, "é漢字🎉 \x00 <|end|> </s>", "x\n\n\ny", None, "a b c d e f", "x" * 100_000]
    return docs_table(spark, texts, [0, 1, 2, 3, 4, 5, 6, 7, 7, 9, 10, None, None, 13])


@pytest.fixture(scope="session")
def no_docs(spark):
    return docs_table(spark, [])
