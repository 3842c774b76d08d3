import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import frame, words  # noqa: E402


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows and repeated ids, ties."""
    rng = random.Random(5)
    long = words(rng, 30_000, 10**6)
    text = words(rng, 120)
    return [
        (1, text, "en", "a"),
        (1, text, "en", "a"),
        (2, text, "en", None),
        (3, None, "en", "a"),
        (4, "", None, "b"),
        (5, " \t\n\x0b\x0c\r ", "de", "b"),
        (None, text + " end", "en", "a"),
        (None, None, None, None),
        (6, long, "en", "c"),
        (7, long + " tail", "en", "c"),
        (1, "another text under a used id", "fr", "b"),
        (8, "😀 ünïcode—words 漢字 " * 20, "fr", "b"),
        (9, "x", None, "a"),
        (10, "12 34 !?", "en", "a"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows, extra=True).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
