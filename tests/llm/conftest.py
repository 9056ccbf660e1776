import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

LONG = "word " * 40_000


@pytest.fixture(scope="session")
def small(spark, sf):
    """Documents of the smallest folder."""
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    text = "The quick brown fox jumps over the lazy dog near the old mill while seven grey geese cross a frozen lake. "
    rows = [
        (1, "", "en", "a", 0, "x", 1), (2, None, None, None, None, None, None), (None, text * 3, "en", "a", 3, "x", 1), (None, None, None, None, None, None, None),
        (3, LONG, "en", "a", 1, "x", 1), (4, text * 3, "en", "a", 1, "x", 1), (4, text * 3, "en", "a", 1, "x", 1), (4, text * 2 + "Another end here.", "en", "b", 2, "y", 2),
        (5, text * 3, "de", "b", 5, "y", 2), (-7, "tiny", "fr", "c", 9, "z", 3), (6, "\x00 \t\n odd 　 \U0001f600", "xx", "c", 9, "z", 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, rate int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
