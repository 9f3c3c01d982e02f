"""Invented texts and tables for the tests of this folder."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use inside
CLASH = ("score", "part", "gone", "lines_gone", "fp", "label", "key", "spans")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice(("ka", "lo", "mi", "ren", "su", "tor", "ve")) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from (doc_id, text[, source]) rows, with extra columns whose names clash."""

    def make(rows, clash=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        schema = SCHEMA
        if clash:
            full = [(*r, *("x" for _ in CLASH)) for r in full]
            schema += "".join(f", {c} string" for c in CLASH)
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank and very long texts, repeated rows, copies and null ids."""
    long = prose(1, 60_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, prose(2, 90)), (5, prose(2, 90)), (6, prose(2, 90)), (None, prose(3, 40)), (7, "word"), (8, prose(4, 300))]
