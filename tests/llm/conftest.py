import re

import pytest

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) as documents, with columns whose names operators use inside."""

    def make(rows):
        full = [(i, t, "en", None if i is None else f"src{i % 3}", len(t or ""), 1.5, 7) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, length long").repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty texts, white space only, repeated rows, ties, odd characters, a very long text."""
    long_text = " ".join(f"word{i * i % 977} x{i % 31}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, "One two three"), (4, "One two three"), (5, "one TWO three"), (6, long_text), (7, "é Ü \x1c x\x00y 漢字"), (None, "no id here"), (8, "a"), (9, "a")]
