import random

import pytest

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, key string, h long, bucket long, "
           "leaf long, m1 string, node string, class string, class_id long, score string, lanes string, n_words string, "
           "kept boolean, rule string, `group` string, phases string, mix_block string, n_lines string, first long, "
           "starts string, removed string, digest string, held_out string, url string, host string")
EXTRA = (None,) * (COLUMNS.count(",") - 4)


def prose(seed: int, n: int, vocabulary: int = 4000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def frame(spark, rows):
    """Documents (doc_id, text, source) with further columns of clashing names."""
    return spark.createDataFrame(
        [(i, t, "en", s, len(t or ""), *EXTRA) for i, t, s in rows], COLUMNS)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, one word, repeated rows, ties, a text of
    20,000 words and one of one endless word."""
    a = prose(1, 120)
    lines = "\n".join([prose(2, 9), "This line comes back in many documents of this table", prose(3, 12)])
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, a, "a"), (5, a, "a"), (6, a, "b"),
        (None, prose(4, 60), None), (None, None, None), (7, prose(5, 20000), "a"), (8, "x" * 300000, "c"),
        (9, lines, "a"), (10, lines.replace("w1", "v1"), "a"), (11, "same same same same same " * 40, "b"),
        (12, "ünïcödé \u00a0 text\u2003with spaces " + prose(6, 55), "b"), (-3, prose(7, 80) + "\n\n\n", "a"),
        (13, "Page 1 of This line comes back in many documents of this table", "c")]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return frame(spark, edge_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
