"""Quality rules: boosted trees over document statistics, with base rules that always hold.

A word is a run of bytes other than ASCII white space. The statistics of a text come from one pass
over the whole of it. The trees are fitted on a bounded sample of labelled rows (`sample_rows`),
shipped as flat numpy arrays and applied to a batch of documents at a time.

Null and empty texts have no words: all statistics are 0 and `base_failed` is true. Repeated rows are
judged each on its own. Extra columns are ignored. Without labels of both values no trees are
fitted and every score is the share of good labels (a half without labels).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm import boosting
from corpusloom.llm.common import bytes_of, training_rows

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: words beyond which repeated windows are found by array sorts instead of a set of tuples
ARRAY_WORDS = 50_000
UPPER, DIGITS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?.,;:"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_chars", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks")
#: direction in which the score may move with a feature, in the order of `features`
MONOTONE = (0, 0, -1, -1, -1, 1, -1, 0, 0, 0)


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a window of `WINDOW` words that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if len(words) > ARRAY_WORDS:
        known: dict[bytes, int] = {}
        code = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
        for step in (1, 2, 4):
            code = np.unique(code[:-step] * (len(words) + 1) + code[step:], return_inverse=True)[1]
        again = np.bincount(code)[code] > 1
    else:
        windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
        if len(set(windows)) == n:
            return 0
        count = Counter(windows)
        again = np.array([count[w] > 1 for w in windows])
    change = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    change[at] += 1
    np.subtract.at(change, at + WINDOW, 1)
    return int((np.cumsum(change) > 0).sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """`COUNTS` and `MORE` of one text."""
    words = text.split()
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    doubled = 0
    for line in lines:
        if line.strip():
            doubled += line in seen
            seen.add(line)
    chars = len(text.decode("utf-8", "replace"))
    held = [len(text) - len(text.translate(None, kind)) for kind in (SYMBOLS, UPPER, DIGITS, MARKS)]
    blank = len(text) - sum(map(len, words))
    return (len(words), chars - blank, held[0], doubled, _repeated(words), chars, len(lines), len(set(words)), *held[1:])


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < 20) | (100 * n_repeat > 30 * n_words)


def features(s: np.ndarray) -> np.ndarray:
    """Ratios from the statistics (rows x counts), in the order of `MONOTONE`."""
    words, word_chars, symbols, doubled, repeat, chars, lines, distinct, upper, digits, marks = s.astype(float).T
    w, c, n = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.stack(
        [np.log1p(words), word_chars / w, symbols / c, doubled / n, repeat / w, distinct / w, upper / c, digits / c,
         marks / w, np.log1p(words / n)],
        axis=1,
    )


def _stats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(t) for t in batch.column(1).to_pylist()], dtype=np.int64).reshape(-1, 11)
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T)], ["doc_id", *COUNTS, *MORE])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and every statistic, one row per document."""
    rows = bytes_of(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_stats_of, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in (*COUNTS, *MORE)))


def fit_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, **options) -> boosting.Trees:
    """Trees for `labels.quality`, from at most `sample_rows` labelled documents."""
    sample = training_rows(docs, labels, "quality", sample_rows)
    known = document_statistics(sample).join(sample.select("doc_id", "label"), "doc_id")
    got = known.select("label", "doc_id", *COUNTS, *MORE).toPandas().sort_values(["doc_id"], kind="stable")
    return boosting.fit(features(got[[*COUNTS, *MORE]].to_numpy()), got["label"].to_numpy(), MONOTONE, **options)


def apply_rules(docs: DataFrame, trees: boosting.Trees, least: float = 0.5) -> DataFrame:
    """Statistics, base verdict, score and final verdict of every document."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _stats_of(batches):
            s = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            failed = base_failed(s[:, 0], s[:, 4])
            score = trees.probability(features(s))
            more = [pa.array(failed), pa.array(~failed & (score >= least)), pa.array(score)]
            columns = [*batch.columns[: 1 + len(COUNTS)], *more]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    rows = bytes_of(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(judge, f"doc_id {kind}, {counts}, base_failed boolean, kept boolean, score double")

