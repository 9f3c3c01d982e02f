"""Toxicity: a factorization machine over the hashed terms of a text.

score = sigmoid(bias + sum of w over the terms + sum over pairs of terms of <v_i, v_j>): the pair part, computed
in linear time, learns that two terms are toxic together although neither is alone. Terms are the
lower-cased runs of letters and digits of the whole text, each counted once, hashed to `2 ** HASH_BITS` buckets. The model is
fitted in numpy on at most `sample_rows` labelled documents that are not held out; only buckets
that `least_docs` of them share are kept, which bounds the model that is shipped to the executors.

Null and empty texts have no terms and get the score of the bias. Repeated rows are scored each on its
own. Extra columns are ignored. Without labels of both values the score is the share of toxic
labels (0 without labels).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import batches_of, held_out, training_rows

HASH_BITS = 20
FACTORS = 8
#: words whose bucket a worker remembers
REMEMBERED = 400_000

_terms = re.compile(r"[^\W_]+").findall


@dataclass(frozen=True)
class Machine:
    """Kept buckets in order, their weights and factors."""

    buckets: np.ndarray
    weight: np.ndarray
    factor: np.ndarray
    bias: float

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probability for each list of positions in `buckets`."""
        out = np.full(len(rows), self.bias)
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        full = np.flatnonzero(sizes)
        if len(full):
            at = np.concatenate([rows[k] for k in full])
            starts = np.cumsum(sizes[full]) - sizes[full]
            out[full] += _margin(self.weight, self.factor, at, starts)[0]
        # sums over different batches differ in the last bits; copies of a text shall not
        return (1 / (1 + np.exp(-np.clip(out, -30, 30)))).round(9)


def _margin(weight, factor, at, starts):
    v = factor[at]
    total = np.add.reduceat(v, starts, axis=0)
    square = np.add.reduceat(v * v, starts, axis=0)
    return np.add.reduceat(weight[at], starts) + 0.5 * (total * total - square).sum(axis=1), v, total


def bucket_of(term: str) -> int:
    return crc32(term.encode("utf-8", "surrogatepass")) & ((1 << HASH_BITS) - 1)


def fit(rows: list[np.ndarray], label: np.ndarray, epochs=12, rate=0.5, l1=3e-3, l2=3e-2, weight_toxic=2.0, batch=128, least_docs=3, seed=7) -> Machine:
    """Proximal AdaGrad on the log loss: L1 on the weights, L2 on the factors; toxic rows, being few, weigh more."""
    label = np.asarray(label, dtype=float)
    count = np.zeros(1 << HASH_BITS, dtype=np.int32)
    for row in rows:
        count[row] += 1  # a row has a bucket once
    kept = np.flatnonzero(count >= least_docs)
    n, share = len(kept), float(label.mean()) if len(label) else 0.0
    bias = float(np.log(np.clip(share, 1e-9, 1 - 1e-9) / (1 - np.clip(share, 1e-9, 1 - 1e-9))))
    if not 0 < share < 1 or n == 0:
        return Machine(kept[:0], np.zeros(0), np.zeros((0, FACTORS)), bias)
    rng = np.random.default_rng(seed)
    place = np.full(1 << HASH_BITS, -1, dtype=np.int32)
    place[kept] = np.arange(n, dtype=np.int32)
    sizes = np.array([np.count_nonzero(place[r] >= 0) for r in rows])
    flat, ends = np.empty(int(sizes.sum()), dtype=np.int32), np.cumsum(sizes)
    for row, end, size in zip(rows, ends.tolist(), sizes.tolist(), strict=True):
        found = place[row]
        flat[end - size : end] = found[found >= 0]
    rows = np.split(flat, ends[:-1])
    weight, factor = np.zeros(n), rng.normal(0, 0.01, (n, FACTORS))
    seen_w, seen_v, seen_b = np.full(n, 1e-2), np.full((n, FACTORS), 1e-2), 1e-2
    epochs = max(epochs, min(25, 200_000 // len(rows)))  # a small sample is passed over more often
    mean_w, mean_v, mean_b, means = np.zeros(n), np.zeros((n, FACTORS)), 0.0, 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            chosen = [k for k in order[lo : lo + batch] if len(rows[k])]
            if not chosen:
                continue
            sizes = np.array([len(rows[k]) for k in chosen])
            at, starts = np.concatenate([rows[k] for k in chosen]), np.cumsum(sizes) - sizes
            margin, v, total = _margin(weight, factor, at, starts)
            g = (1 / (1 + np.exp(-np.clip(margin + bias, -30, 30))) - label[chosen]) / len(chosen)
            g *= np.where(label[chosen] == 1, weight_toxic, 1.0)
            each = np.repeat(g, sizes)
            used, inverse = np.unique(at, return_inverse=True)
            gw = np.bincount(inverse, each)
            gv = each[:, None] * (np.repeat(total, sizes, axis=0) - v)
            gv = np.stack([np.bincount(inverse, c) for c in gv.T], axis=1) + l2 * factor[used] / len(chosen)
            seen_w[used] += gw * gw
            step = rate / np.sqrt(seen_w[used])
            moved = weight[used] - step * gw
            weight[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            seen_v[used] += gv * gv
            factor[used] -= 0.3 * rate / np.sqrt(seen_v[used]) * gv
            seen_b += g.sum() ** 2
            bias -= rate / np.sqrt(seen_b) * g.sum()
        if epoch >= epochs // 3:  # the model is the mean over the later passes
            mean_w, mean_v, mean_b, means = mean_w + weight, mean_v + factor, mean_b + bias, means + 1
    weight, factor, bias = mean_w / means, mean_v / means, mean_b / means
    live = np.flatnonzero((np.abs(weight) > 0) | (np.abs(factor).max(axis=1) > 1e-3))
    return Machine(kept[live], weight[live], factor[live], float(bias))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, **options) -> Machine:
    """A machine for `labels.toxic`, from at most `sample_rows` labelled documents."""
    sample = training_rows(docs, labels, "toxic", sample_rows)
    batches_of(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted({bucket_of(t) for t in set(_terms((x or "").lower()))}) for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "terms"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed_rows = sample.select("doc_id", "text", "label").mapInArrow(hashed, f"doc_id {kind}, label int, terms array<int>")
    # as Arrow and not as Python objects: the terms of all rows are one buffer
    got = hashed_rows.toArrow().combine_chunks()
    if not got.num_rows:
        return fit([], np.zeros(0), **options)
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    terms = got.column("terms").chunk(0)
    flat, ends = terms.values.to_numpy(), terms.offsets.to_numpy()
    label = got.column("label").to_numpy()[order]
    return fit([flat[ends[k] : ends[k + 1]] for k in order], label, **options)


class _Finder:
    """Positions of a text's terms in the model; remembers the words that it has seen."""

    def __init__(self, machine: Machine):
        self.place = np.full(1 << HASH_BITS, -1, dtype=np.int32)
        self.place[machine.buckets] = np.arange(len(machine.buckets))
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = set()
        for term in set(_terms(text.lower())) if text else ():
            at = self.known.get(term)
            if at is None:
                at = self.known[term] = int(self.place[bucket_of(term)])
            found.add(at)
        found.discard(-1)
        return np.array(sorted(found), dtype=np.int64)


def score_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5 on) of every document."""
    batches_of(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Finder(machine)
        for batch in batches:
            score = machine.score([find(t) for t in batch.column(1).to_pylist()])
            columns = [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """The documents with a score under 0.5, with all their columns; null texts count as empty."""
    batches_of(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Finder(machine)
        for batch in batches:
            keep = machine.score([find(t) for t in batch.column(at).to_pylist()]) < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
