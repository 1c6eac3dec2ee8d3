import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, score string, token string, part string, size string, label string"


def make(spark, rows):
    """Documents (id, text[, lang[, source]]) with extra columns whose names operators use inside."""
    full = [(r[0], r[1], (r[2] if len(r) > 2 else "en"), (r[3] if len(r) > 3 else "s"), len(r[1] or ""), 7, "k", "x", "t", "p", "z", "l") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture
def docs_of(spark):
    return lambda rows: make(spark, rows)


@pytest.fixture
def odd(spark):
    """Null, empty, blank, tiny, very long, repeated rows; null ids, languages and sources."""
    long = " ".join(f"word{k % 997}x{k}" for k in range(30000))
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "Eins zwei."), (6, long), (7, long + " end"), (8, "é" * 70000), (9, "same text here again and again"),
        (9, "same text here again and again"), (10, "same text here again and again"), (None, "a null id"), (None, None), (11, "no language", None, None), (12, "... --- 123 !!!"),
    ]
    return make(spark, rows)
