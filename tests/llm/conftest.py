import random

import pytest

EXTRA = "th long, text_hash long, node string, h int, times int, row int, spans string, bucket int, kind string, item_id long, key string, epoch int"
NONE = (1, 2, "x", 3, 4, 5, "y", 6, "z", 7, "k", 8)


def text(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, odd characters, copies and near copies."""
    rng = random.Random(17)
    base = text(rng, 120)
    near = base.split()
    near[60] = "changed"
    long = text(rng, 20_000)
    texts = [base, base, " ".join(near), long, "", None, "   \n\t", "%%% &&&", "%%% &&&", "one two", "One, two!", "short", "日本語 テキスト ñandú", "🙂 🙂", base.upper(), text(rng, 300), "x" * 5000, "ab" * 700, "12 345 6.7"]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "a")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], rows[5], (None, base, "en", "a", 1), (None, None, None, None, None), (3, "another text with the id of a long one", "en", "b", 3)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([(*r, *NONE) for r in odd_rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
