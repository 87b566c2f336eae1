import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

SF = "/root/testdata/sf0.001"
LONG = "Wordy " * 30_000 + "a@b.co " + "x" * 50_000 + " 10.0.0.1"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark, documents):
    """Nulls in any column, empty and long texts, repeated rows and ties, clashing extra columns."""
    base = "One two three four five six seven eight nine ten eleven twelve. "
    rows = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, base, None, "b"), (None, base, "en", None), (3, None, "en", "a"),
        (4, "", "de", None), (5, " \t\n ", "de", "b"), (None, None, None, None), (6, LONG, "en", "a"), (7, LONG, "fr", "a"),
        (8, "déjà vu été", "fr", "b"), (9, " no break\x0bvt", "fr", "c"), (10, "12345 67890", None, "c"),
        (11, base + "and a tail that differs.", "en", "d"), (2, "another text under the same key, with ten words or more.", "en", "b"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = ["kept", "fp", "n", "run", "size", "id", "h", "part", "node", "_key", "_text", "_hash", "n_words", "position", "score", "x"]
    from pyspark.sql import functions as F
    return frame.select("*", F.length("text").cast("long").alias("n_chars"), *[F.lit("clash").alias(c) for c in names])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
