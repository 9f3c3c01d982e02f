"""Spelling variants."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from conftest import DATA
from corpusloom.llm import spelling
from corpusloom.llm.queries import QUERIES
from llm_texts import frame, odd_rows, prose  # noqa: F401


def brute(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    gaps = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            gaps[len(w), i, w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def varied(seed, n):
    """Words that are close to each other, with repeats of very different numbers."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = list(rng.choice(("kalorens", "mitorve", "surenlo", "ÀÉreng", "TORVEN", "abcde", "edcba")))
        for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
            at = rng.randrange(len(base))
            base[at : at + 1] = rng.choice(([], ["x"], ["a"], [base[at], "é"], ["ÿ"]))
        out.append("".join(base))
    return " ".join(out)


@pytest.mark.parametrize(("sample", "cell"), [(spelling.SAMPLE_WORDS, spelling.CELL_WORDS), (60, 10), (1, 1)])
def test_forms_equal_brute_force(frame, monkeypatch, sample, cell):
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    rows = [(k, varied(k, 120)) for k in range(30)] + [(31, "x" * 5000 + " " + "x" * 5001), (31, "x" * 5000), (32, "x" * 5000 + " " + "x" * 5001 + "." + "x" * 5001)]
    want = brute(rows)
    assert sum(f is not None for _, f, *_ in want) > 30 and any(f != r for _, f, r, *_ in want if f)
    assert rows_of(spelling.variant_forms(frame(rows), sample, cell)) == want


def test_given_documents_equal_brute_force(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    want = brute(zip(docs.doc_id, docs.text, strict=True))
    assert len(want) > 500 and rows_of(QUERIES["op13_spelling"](spark, DATA)) == want


def test_odd_rows(frame, odd_rows):
    rows = [*odd_rows, (None, "Maßstab ×÷ÀÖÿ ×÷ÀÖÿ ×÷ÀÖÿ İıſK"), (None, None)]
    assert rows_of(spelling.variant_forms(frame(rows))) == brute(rows)
    assert rows_of(spelling.variant_forms(frame(rows).limit(0))) == []


def test_boxes_are_pruned_and_lose_nothing():
    words = sorted({w for w in varied(9, 6000).lower().split() if len(w) == 7} | {prose(k, 1)[:7].ljust(7, "q") for k in range(900)})
    vectors, letters = spelling.letter_counts(words), spelling._letters(words)
    tree = spelling.Tree(vectors, 8, tight=True)
    found = {(words[a], words[b]) for x, y in spelling.near_in_cell(tree, vectors, letters, vectors, letters, 1, 1) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert found == {(v, w) for v in words for w in words if sum(a != b for a, b in zip(v, w, strict=True)) == 1}
    leaves = sum(not c for c in tree.children)
    reached = sum(len(q) for _, q in tree.reach(vectors, 1, 1))
    assert reached < 0.7 * leaves * len(words)
    placed = np.concatenate([q for _, q in spelling.Tree(vectors[:50], 4, tight=False).reach(vectors, 0, 0)])
    assert sorted(placed.tolist()) == list(range(len(words)))


def test_paths_are_followed_to_their_end(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(20)] + [("a", "w7"), ("b", "c")]
    got = dict(spelling.follow(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == {w: "c" if w == "b" else "w20" for w, _ in chain}
