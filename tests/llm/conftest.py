import random

import pytest

EXTRA = ["text", "size", "n", "key", "row", "rank", "node", "h", "g", "id", "first", "lang_pred", "n_lines", "n_removed", "piece", "start"]


def words(rng, n, vocab="abcdefghij"):
    return " ".join("".join(rng.choice(vocab) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(4)
    long_text = words(rng, 60_000)
    rows = [
        (1, "A plain text, of some words.\nAnd a second line of it.", "en", "s1"), (1, "A plain text, of some words.\nAnd a second line of it.", "en", "s1"),
        (2, None, "en", "s1"), (3, "", None, None), (None, "no id here at all, but words", "fr", "s2"), (None, None, None, None),
        (5, long_text, "de", "s2"), (6, " \n\t ", "de", ""), (7, "x" * 30_000, None, "s3"), (8, "###", "es", "s3"), (9, "é漢🎉   z", "es", "s3"), (1, "another text of the same id", "en", "s4"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "length(text) as n_chars", *[f"'clash' as `{c}`" for c in EXTRA if c not in df.columns])
