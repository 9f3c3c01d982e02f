"""Quality rules, toxicity and quality classifier."""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from conftest import DATA
from corpusloom.llm import boosting, passages, quality_rules, toxicity
from corpusloom.llm.queries import QUERIES
from llm_texts import frame, odd_rows  # noqa: F401

LARGER = "/root/testdata/sf0.01"


def slow_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    hit = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    lines, doubled = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubled += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), doubled, len(hit)


@pytest.mark.parametrize("text", ["", "a b", "é ü x\x1cy\nz\n\nz", "a b c d e f g h " * 3, "x " * 30, "one # two\r\n" * 4, "\x0b\x0c \t"])
def test_statistics_by_hand(text):
    assert quality_rules.statistics(text.encode())[:5] == slow_statistics(text)


def test_long_texts_take_the_same_windows(monkeypatch):
    text = " ".join(str(k % 37 if k % 5 else k) for k in range(3000)) + " a b c d e f g h" * 3
    usual = quality_rules.statistics(text.encode())
    monkeypatch.setattr(quality_rules, "ARRAY_WORDS", 10)
    assert quality_rules.statistics(text.encode()) == usual
    assert usual[:5] == slow_statistics(text)


def test_quality_rules_on_all_documents(spark):
    got = QUERIES["op1_quality_rules"](spark, DATA).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    assert len(got) == len(docs)
    for r in docs.itertuples():
        n = slow_statistics(r.text)
        assert tuple(got.loc[r.doc_id][list(quality_rules.COUNTS)]) == n
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        assert got.loc[r.doc_id].base_failed == failed and not (failed and got.loc[r.doc_id].kept)


def test_monotone_trees_follow_their_direction():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = ((x[:, 0] + 0.5 * np.sin(9 * x[:, 1]) + rng.normal(0, 0.3, 600)) > 0.6).astype(int)
    trees = boosting.fit(x, y, (1, -1, 0), trees=30)
    at = rng.random((50, 3))
    for f, sign in ((0, 1), (1, -1)):
        grid = np.repeat(at, 40, axis=0)
        grid[:, f] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(trees.margin(grid).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-12).all()
    free = boosting.fit(x, y, (0, 0, 0), trees=30)
    assert ((free.probability(x) >= 0.5) == y).mean() > 0.85


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(2)
    x, y = rng.random((200, 2)), rng.integers(0, 2, 200)
    t = boosting.fit(x, y, (0, 0), trees=5)
    for row, margin in zip(x[:20], t.margin(x[:20]), strict=True):
        total = t.bias
        for k in range(len(t.feature)):
            node = 0
            while t.left[k, node] != node:
                node = t.left[k, node] if row[t.feature[k, node]] <= t.threshold[k, node] else t.right[k, node]
            total += t.value[k, node]
        assert abs(total - margin) < 1e-9


def test_machine_learns_a_pair():
    """Neither of two terms is toxic alone; the pair is."""
    rng = np.random.default_rng(3)
    rows, label = [], []
    for _ in range(3000):
        own = set(rng.choice(np.arange(10, 200), 6).tolist())
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array(sorted(own | ({1} if a else set()) | ({2} if b else set()))))
        label.append(int(a and b))
    m = toxicity.fit(rows, np.array(label), epochs=20, l1=1e-4, l2=1e-3)
    place = {int(b): k for k, b in enumerate(m.buckets)}
    one = lambda *terms: m.score([np.array([place[t] for t in terms])])[0]
    assert one(1, 2) > 0.5 > max(one(1), one(2))
    pair = float(m.factor[place[1]] @ m.factor[place[2]])
    assert pair > 0.3


def test_machine_margin_by_brute_force():
    rng = np.random.default_rng(4)
    m = toxicity.Machine(np.arange(9), rng.normal(size=9), rng.normal(size=(9, toxicity.FACTORS)), 0.3)
    rows = [np.array([0, 3, 8]), np.array([], dtype=int), np.array([5])]
    for row, p in zip(rows, m.score(rows), strict=True):
        z = 0.3 + m.weight[row].sum() + sum(m.factor[i] @ m.factor[j] for i in row for j in row if i < j)
        assert abs(p - 1 / (1 + np.exp(-z))) < 1e-8


def test_attention_gradient():
    rng = np.random.default_rng(5)
    x, sizes, y = rng.normal(size=(7, passages.WIDTH)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    shapes = {"encode": (passages.WIDTH, 4), "encode_b": (4,), "tanh": (4, 3), "gate": (4, 3), "attend": (3,), "score": (4,), "score_b": (1,)}
    w = {k: rng.normal(0, 0.3, s) for k, s in shapes.items()}

    def loss():
        p = passages._forward(w, x, sizes)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = passages._gradient(w, x, sizes, y)
    for name, g in grad.items():
        at = tuple(rng.integers(0, s) for s in w[name].shape)
        old, step = w[name][at], 1e-5
        w[name][at] = old + step
        up = loss()
        w[name][at] = old - step
        down = loss()
        w[name][at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 1e-6, name


def test_describe_counts_every_word():
    texts = [b"", b"A b  c#\nd", b"x " * 130, b"  \n"]
    x, n = passages.describe(texts)
    assert n.tolist() == [1, 1, 3, 1]
    assert np.expm1(x[:, 0]).round().tolist() == [0, 4, 64, 64, 2, 0]
    assert x[2, 3] > 0.9 and x[1, 3] == 0
    alone = [passages.describe([t])[0] for t in texts]
    assert np.allclose(np.concatenate(alone), x)


@pytest.mark.parametrize(("name", "label", "least"), [("op2_toxicity", "toxic", 0.85), ("op10_quality_classifier", "quality", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    got = QUERIES[name](spark, LARGER).toPandas()
    docs = pd.read_parquet(f"{LARGER}/documents.parquet")
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (got.predicted == (got.score >= (0.5 if label == "toxic" else 0.3))).all()
    labels = pd.read_parquet(f"{LARGER}/labels.parquet")
    both = got[got.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both[label]).mean() >= least


def test_odd_rows(spark, frame, odd_rows):
    docs = frame(odd_rows)
    labels = spark.createDataFrame([(1, 0, 1, "x"), (5, 1, 0, "x"), (8, 1, 0, "x"), (None, 1, 1, "x"), (7, None, None, "x")], "doc_id long, quality int, toxic int, score string")
    empty, none = docs.limit(0), labels.limit(0)
    for use in (labels, none):
        trees = quality_rules.fit_rules(docs, use)
        machine = toxicity.fit_toxicity(docs, use)
        model = passages.fit_classifier(docs, use)
        judged = quality_rules.apply_rules(docs, trees).collect()
        assert len(judged) == len(odd_rows)
        assert all(r.base_failed and r.n_words == 0 for r in judged if r.doc_id in (1, 2, 3))
        for scored in (toxicity.score_toxicity(docs, machine), passages.score_quality(docs, model)):
            rows = scored.collect()
            assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
            assert len({r.score for r in rows if r.doc_id in (5, 6)}) == 1
        assert toxicity.drop_toxic(docs, machine).columns == docs.columns
        for out in (quality_rules.apply_rules(empty, trees), toxicity.score_toxicity(empty, machine), passages.score_quality(empty, model), toxicity.drop_toxic(empty, machine)):
            assert out.count() == 0
    trees = quality_rules.fit_rules(empty, labels)
    assert quality_rules.apply_rules(docs, trees).count() == len(odd_rows)
