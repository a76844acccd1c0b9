"""Frames that every operator has to take."""

import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, clashing extra columns."""
    long = prose(30_000, 1)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "Hello"), (4, "Hello"), (5, long), (6, "a " * 3000), (7, "naïve ſecret ünïcode 😀 text"), (8, prose(80, 2)), (8, prose(80, 2))]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    extra = {c: F.lit("clash") for c in ("path", "votes", "block", "slot", "component_id", "fp", "seed", "place", "number", "n_email", "score", "kind")}
    return frame.withColumns(extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)
