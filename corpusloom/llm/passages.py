"""Quality classifier: attention-based multiple-instance learning over the passages of a text.

A text is cut into passages of `PASSAGE` words (the last may be shorter; a text without words is one passage).
Every passage of the whole text is described by counts over its bytes and words, encoded by one tanh
layer, and weighted by gated attention (tanh and sigmoid branch, softmax over the document's passages). The weighted
mean of the encodings is scored. Only documents have labels, so encoder, attention and score are learned
together, in numpy, on at most `sample_rows` labelled documents that are not held out.

Null and empty texts are one passage of zeros. Repeated rows are scored each on its own. Extra columns are
ignored. Without labels of both values the score is the share of ones (a half without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import bytes_of, held_out, training_rows

PASSAGE = 64
LENGTHS = 12
TERM_BUCKETS = 64
#: bytes of text that are described at a time
CHUNK_BYTES = 4_000_000

_KINDS = np.zeros((256, 8), dtype=np.uint8)
for _kind, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b"!?.,;:'\"()-", b"#*$%&|<>", b"\n", b" \t\r\v\f\n", range(128, 256))):
    _KINDS[list(_chars), _kind] = 1
_SPACE = _KINDS[:, 6].astype(bool)
_MIX = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
WIDTH = 6 + 8 + LENGTHS + TERM_BUCKETS


def _words(data: np.ndarray, offsets: np.ndarray):
    """Start, end, document and hash of every word."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside])[:-1] if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    with np.errstate(over="ignore"):
        # a sum of mixed bytes times their place within the word, wrapping at 64 bits
        first = np.zeros(len(data), dtype=np.int64)
        first[start] = np.diff(start, prepend=0)
        place = (np.arange(len(data)) - np.cumsum(first)).astype(np.uint64)
        mixed = _MIX[data] * (place * _BASE + np.uint64(1))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        code = total[end] - total[start]
        code ^= code >> np.uint64(29)
        code *= _BASE
    return start, end, doc, code


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (passages x WIDTH) and the number of passages of each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    start, end, doc, code = _words(data, offsets[:-1])
    n_words = np.bincount(doc, minlength=len(texts))
    first_word = np.cumsum(n_words) - n_words
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    first_passage = np.cumsum(n_passages) - n_passages
    passage = first_passage[doc] + (np.arange(len(start)) - first_word[doc]) // PASSAGE
    total = int(n_passages.sum())
    owner = np.repeat(np.arange(len(texts)), n_passages)
    # a passage begins with its first word, the first one of a text with the text
    begin = offsets[:-1][owner].copy()
    opens = (np.arange(len(start)) - first_word[doc]) % PASSAGE == 0
    later = opens & (np.arange(len(start)) != first_word[doc])
    begin[passage[later]] = start[later]
    finish = np.append(begin[1:], len(data))
    out = np.zeros((total, WIDTH), dtype=np.float32)
    length = np.maximum(finish - begin, 1)
    for kind in range(8):
        sums = np.concatenate([[0], np.cumsum(_KINDS[data, kind], dtype=np.int64)])
        out[:, 6 + kind] = (sums[finish] - sums[begin]) / length
    words = np.bincount(passage, minlength=total)
    some = np.maximum(words, 1)
    out[:, 0], out[:, 1] = np.log1p(words), np.log1p(finish - begin)
    order = np.lexsort((code, passage))
    p, c = passage[order], code[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
    out[:, 2] = np.bincount(p[new], minlength=total) / some
    same = np.zeros(len(passage), dtype=bool)
    same[1:] = (code[1:] == code[:-1]) & (passage[1:] == passage[:-1])
    out[:, 3] = np.bincount(passage[same], minlength=total) / some
    out[:, 4] = np.bincount(passage, end - start, minlength=total) / some / 10
    out[:, 5] = (words == 0)
    long = np.minimum(end - start, LENGTHS) - 1
    out[:, 14 : 14 + LENGTHS] = np.bincount(passage * LENGTHS + long, minlength=total * LENGTHS).reshape(total, LENGTHS) / some[:, None]
    bucket = (code >> np.uint64(58)).astype(np.int64)
    counts = np.bincount(passage * TERM_BUCKETS + bucket, minlength=total * TERM_BUCKETS).reshape(total, TERM_BUCKETS)
    out[:, 14 + LENGTHS :] = counts / some[:, None]
    return out, n_passages


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    chunk, size = [], 0
    for text in texts:
        if chunk and size + len(text) > CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


@dataclass(frozen=True)
class Attention:
    """Weights of the encoder, the two gates, the attention and the score."""

    weights: dict[str, np.ndarray]
    center: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(sizes), self.constant)
        return _forward(self.weights, (x - self.center) / self.scale, sizes)["p"]


def _forward(w, x, sizes):
    starts = np.cumsum(sizes) - sizes
    h = np.tanh(x @ w["encode"] + w["encode_b"])
    u, g = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-(h @ w["gate"])))
    e = (u * g) @ w["attend"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    a = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ w["score"] + w["score_b"], -30, 30)))
    return {"h": h, "u": u, "g": g, "a": a, "z": z, "p": p, "starts": starts}


def _gradient(w, x, sizes, y):
    f = _forward(w, x, sizes)
    h, u, g, a = f["h"], f["u"], f["g"], f["a"]
    ds = (f["p"] - y) / len(y)
    out = {"score": f["z"].T @ ds, "score_b": ds.sum(keepdims=True)}
    dz = np.repeat(ds[:, None] * w["score"][None, :], sizes, axis=0)
    da = (h * dz).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, f["starts"]), sizes))
    out["attend"] = (u * g).T @ de
    dug = de[:, None] * w["attend"][None, :]
    du, dg = dug * g * (1 - u * u), dug * u * g * (1 - g)
    out["tanh"], out["gate"] = h.T @ du, h.T @ dg
    dh = (a[:, None] * dz + du @ w["tanh"].T + dg @ w["gate"].T) * (1 - h * h)
    out["encode"], out["encode_b"] = x.T @ dh, dh.sum(axis=0)
    return out


def fit(bags: list[np.ndarray], label, hidden=24, gate=12, epochs=25, rate=3e-3, decay=1e-4, batch=128, seed=5) -> Attention:
    """Adam on the log loss of the documents."""
    label = np.asarray(label, dtype=float)
    if len(label) == 0 or label.min() == label.max():
        return Attention({}, np.zeros(WIDTH), np.ones(WIDTH), float(label.mean()) if len(label) else 0.5)
    rng = np.random.default_rng(seed)
    rows = np.concatenate(bags)
    center, scale = rows.mean(axis=0, dtype=float), rows.std(axis=0, dtype=float) + 1e-3
    shapes = {"encode": (WIDTH, hidden), "encode_b": (hidden,), "tanh": (hidden, gate), "gate": (hidden, gate), "attend": (gate,), "score": (hidden,), "score_b": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if not k.endswith("_b") else np.zeros(s) for k, s in shapes.items()}
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            chosen = order[lo : lo + batch]
            sizes = np.array([len(bags[k]) for k in chosen])
            x = (np.concatenate([bags[k] for k in chosen]) - center) / scale
            step += 1
            for k, g in _gradient(w, x, sizes, label[chosen]).items():
                g = g + decay * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Attention(w, center, scale)


def fit_classifier(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 10_000, **options) -> Attention:
    """A model for one label column, from at most `sample_rows` labelled documents."""
    sample = bytes_of(training_rows(docs, labels, label, sample_rows), "text", "doc_id", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for chunk in _chunks(batch.column(1).to_pylist()):
                x, sizes = describe(chunk)
                bags += [b.tobytes() for b in np.split(x, np.cumsum(sizes)[:-1])]
            columns = [batch.column(0), batch.column(2), pa.array(bags, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "bag"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"doc_id {kind}, label int, bag binary").toPandas().sort_values("doc_id", kind="stable")
    bags = [np.frombuffer(b, dtype=np.float32).reshape(-1, WIDTH) for b in got["bag"]]
    return fit(bags, got["label"].to_numpy(), **options)


def score_quality(docs: DataFrame, model: Attention, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from `least` on) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(*describe(chunk)) for chunk in _chunks(batch.column(1).to_pylist())]
            # products over different batches differ in the last bits; copies of a text shall not
            score = np.concatenate([*parts, np.zeros(0)]).round(9)
            columns = [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= least).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = bytes_of(docs, "text", "doc_id", held_out().alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
