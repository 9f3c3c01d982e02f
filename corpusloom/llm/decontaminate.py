"""Benchmark decontamination: a BM25 index of the test items, asked with every passage of every document.

Words are lower-cased runs of letters and digits. Items are indexed in segments of at most `STRIDE` words; documents are read
as passages of two strides that begin at every stride, so each segment that a text holds lies within one
passage. A segment's score for a passage is the BM25 sum over the passage's distinct words, as a share of the
segment's own sum. Retrieval is block-max WAND for a batch of passages at a time: segments lie
in blocks of similar total, each word has the greatest weight of its postings per block, and only blocks whose
greatest weights add up to the threshold for a passage are scored, so all segments at or above the threshold
and no other blocks are read. Retrieved items are verified over the document: at least `least`
(0.8) of the five-word shingles of both the item's question and its answer must occur in it. As one changed word takes five
shingles, a part of five to `SHORT` words also passes at an edit similarity of `least` with some run of words
around the retrieved passages. The answer is the last sentence of an item and the question what stands before; an item of
one sentence is both. A part of fewer than five words is one shingle.

Statistics are taken over all items. The index that a task holds is bounded: items are dealt into shards of
about `SHARD_ITEMS`, and each shard is one pass over the documents. Passages are looked up in runs whose bounds fit `BOUNDS` numbers,
however long a text is. Null and empty texts and items match nothing. Repeated
rows of documents are reported each on its own, and items with the same id are one item per text. Extra columns are
ignored. Without items nothing is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of

STRIDE = 64
BLOCK = 8
SHINGLE = 5
K1, B = 1.2, 0.75
SHARD_ITEMS = 20_000
#: words below which a part may also pass by edit similarity
SHORT = 29
#: bounds of passages by blocks that are held at a time
BOUNDS = 1 << 22
#: words of documents that are looked up together
CHUNK_WORDS = 200_000

_terms = re.compile(r"[^\W_]+").findall
_ends = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[str]:
    return _terms(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    parts = [w for w in map(words_of, _ends.split(text)) if w]
    if len(parts) < 2:
        return (parts[0], parts[0]) if parts else ([], [])
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingles(words: list[str]) -> list[str]:
    """Distinct shingles, each between spaces."""
    if not words:
        return []
    return list(dict.fromkeys(" " + " ".join(words[k : k + SHINGLE]) + " " for k in range(max(1, len(words) - SHINGLE + 1))))


@dataclass(frozen=True)
class Index:
    """Postings by word: blocks with their greatest weight, and segments with their weight."""

    words: dict[str, int]
    block_of_word: np.ndarray
    blocks: np.ndarray
    block_max: np.ndarray
    segment_of_word: np.ndarray
    segments: np.ndarray
    weight: np.ndarray
    item: np.ndarray
    ids: list
    parts: list[tuple[list[str], list[str]]]
    n_blocks: int

    @classmethod
    def of(cls, items: list[tuple], frequency: dict[str, int], n_segments: int, mean_words: float) -> Index:
        """From (id, text) and the statistics over the segments of all items."""
        rows = []
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            for lo in range(0, len(words), STRIDE):
                part = words[lo : lo + STRIDE]
                weights = {}
                for word in set(part):
                    n, tf = frequency[word], part.count(word)
                    idf = np.log(1 + (n_segments - n + 0.5) / (n + 0.5))
                    weights[word] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(part) / mean_words))
                total = sum(weights.values())
                rows.append((total, k, {w: x / total for w, x in weights.items()}))
        rows.sort(key=lambda r: (r[0], r[1]))
        words = {w: n for n, w in enumerate(sorted({w for r in rows for w in r[2]}))}
        posts = sorted((words[w], s, x) for s, r in enumerate(rows) for w, x in r[2].items())
        word = np.array([p[0] for p in posts], dtype=np.int64)
        segments = np.array([p[1] for p in posts], dtype=np.int64)
        weight = np.array([p[2] for p in posts], dtype=float)
        n_blocks = -(-len(rows) // BLOCK)
        key, first = np.unique(word * max(1, n_blocks) + segments // BLOCK, return_index=True)
        most = np.maximum.reduceat(weight, first) if len(weight) else weight
        every = np.arange(len(words) + 1)
        return cls(
            words, np.searchsorted(key // max(1, n_blocks), every), key % max(1, n_blocks), most,
            np.searchsorted(word, every), segments, weight, np.array([r[1] for r in rows], dtype=np.int64),
            [i for i, _ in items], [question_and_answer(t) for _, t in items], n_blocks,
        )

    def retrieve(self, passage: np.ndarray, word: np.ndarray, n: int, threshold: float):
        """(passage, segment, score) of everything at or above the threshold, from distinct (passage, word) pairs."""
        if not len(word) or not self.n_blocks:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        owner, at = _expand(self.block_of_word, word)
        bound = np.bincount(passage[owner] * self.n_blocks + self.blocks[at], self.block_max[at], n * self.n_blocks)
        open_ = bound >= threshold - 1e-9
        some = open_.reshape(n, self.n_blocks).any(axis=1)[passage]
        passage, word = passage[some], word[some]
        owner, at = _expand(self.segment_of_word, word)
        where, segment = passage[owner], self.segments[at]
        keep = open_[where * self.n_blocks + segment // BLOCK]
        key, inverse = np.unique(where[keep] * len(self.item) + segment[keep], return_inverse=True)
        score = np.bincount(inverse, self.weight[at[keep]], len(key))
        found = score >= threshold - 1e-9
        return key[found] // len(self.item), key[found] % len(self.item), score[found]


def _expand(starts: np.ndarray, word: np.ndarray):
    """For every word the places of its postings: index of the word's entry, place."""
    size = starts[word + 1] - starts[word]
    owner = np.repeat(np.arange(len(word)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + starts[word][owner]


def edit_share(part: list[str], text: list[str]) -> float:
    """1 - the least edit distance, per word of the part, of the part to any run of words of the text."""
    at: dict[str, int] = {}
    for n, x in enumerate(part):
        at[x] = at.get(x, 0) | 1 << n
    full, last = (1 << len(part)) - 1, 1 << (len(part) - 1)
    up, down, distance, least = full, 0, len(part), len(part)
    for x in text:
        same = at.get(x, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        rises, falls = down | (full & ~(across | up)), up & across
        distance += bool(rises & last) - bool(falls & last)
        least = min(least, distance)
        rises, falls = rises << 1 & full, falls << 1 & full  # a run may begin anywhere
        up, down = falls | (full & ~(vertical | rises)), rises & vertical
    return 1 - least / len(part)


def _retrieved(index: Index, pair: np.ndarray, n: int, threshold: float):
    """`Index.retrieve` for sorted (passage, word) pairs, in runs of passages."""
    size, run = len(index.words), max(1, BOUNDS // max(1, index.n_blocks))
    parts = []
    for lo in range(0, n, run):
        own = pair[np.searchsorted(pair, lo * size) : np.searchsorted(pair, (lo + run) * size)]
        passage, segment, score = index.retrieve(own // size - lo, own % size, min(run, n - lo), threshold)
        parts.append((passage + lo, segment, score))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _leaks(index: Index, texts: list[str | None], threshold: float, least: float):
    """(row, item, score, question overlap, answer overlap) of the verified items of a list of texts."""
    find, out, lo = index.words.get, [], 0
    while lo < len(texts):
        hi, held, read = lo, [], 0
        while hi < len(texts) and (hi == lo or read < CHUNK_WORDS):
            held.append(words_of(texts[hi]))
            read += len(held[-1])
            hi += 1
        sizes = np.array([len(w) for w in held], dtype=np.int64)
        strides = np.maximum(1, -(-sizes // STRIDE))
        first = np.cumsum(strides) - strides
        row = np.repeat(np.arange(len(held)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        word = np.array([find(w, -1) for ws in held for w in ws], dtype=np.int64)
        known = word >= 0
        chunk, word, row = (first[row] + at // STRIDE)[known], word[known], row[known]
        # the passage that begins with a stride also holds the next one of the same text
        back = chunk > first[row]
        n, size = int(strides.sum()), len(index.words)
        pair = np.unique(np.concatenate([chunk * size + word, (chunk[back] - 1) * size + word[back]]))
        passage, segment, score = _retrieved(index, pair, n, threshold) if size and n else ([], [], [])
        owner = np.repeat(np.arange(len(held)), strides)
        best: dict[tuple[int, int], float] = {}
        where: dict[tuple[int, int], list[int]] = {}
        for p, s, x in zip(passage, segment, score, strict=True):
            key = (int(owner[p]), int(index.item[s]))
            best[key] = max(best.get(key, 0.0), float(x))
            where.setdefault(key, []).append(int(p - first[key[0]]) * STRIDE)
        joined: dict[int, str] = {}
        for (r, item), x in sorted(best.items()):
            whole = joined.setdefault(r, " " + " ".join(held[r]) + " ")
            parts = index.parts[item]
            shares = [sum(s in whole for s in part) / len(part) for part in map(shingles, parts)]
            for k, part in enumerate(parts):
                if shares[k] < least and SHINGLE <= len(part) < SHORT:
                    reach = sum(map(len, parts))
                    near = held[r][max(0, min(where[r, item]) - reach) : max(where[r, item]) + 2 * STRIDE + reach]
                    shares[k] = max(shares[k], edit_share(part, near))
            if min(shares) >= least - 1e-9:
                out.append((lo + r, item, x, *shares))
        lo = hi
    return out


def build_indexes(items: DataFrame) -> list[Index]:
    """One index per shard of items; statistics are over all items."""
    batches_of(items.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(t) for t in batch.column(0).to_pylist()]
            parts = [w[lo : lo + STRIDE] for w in found for lo in range(0, len(w), STRIDE)]
            columns = [pa.array([len(p) for p in parts], pa.int64()), pa.array([sorted(set(p)) for p in parts], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["n", "words"])

    rows = items.where(F.length("text") > 0).select("item_id", "text").distinct()
    segments = rows.select("text").mapInArrow(cut, "n long, words array<string>")
    count = segments.agg(F.count(F.lit(1)), F.avg("n")).first()
    if not count[0]:
        return []
    frequency = segments.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    shards = -(-rows.count() // SHARD_ITEMS)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    out = []
    for shard in range(shards):
        own = dealt.where(F.col("shard") == shard).select("item_id", "text")
        held = sorted(((r.item_id, r.text) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        used = own.select("text").mapInArrow(cut, "n long, words array<string>").select(F.explode("words").alias("word")).distinct()
        df = {r.word: r.df for r in frequency.join(used, "word", "left_semi").collect()}
        out.append(Index.of(held, df, count[0], float(count[1])))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.4, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, score (share of the item's BM25 sum), question_overlap and answer_overlap of every leak."""
    batches_of(docs.sparkSession)
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    found = docs.sparkSession.createDataFrame([], schema)
    for index in build_indexes(items):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaks = _leaks(index, batch.column(1).to_pylist(), threshold, least)
                doc = batch.column(0).take(pa.array([x[0] for x in leaks], pa.int64()))
                item = pa.array([index.ids[x[1]] for x in leaks], pa.int64() if item_kind == "bigint" else None)
                rest = [pa.array([x[k] for x in leaks], pa.float64()) for k in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([doc, item, *rest], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = found.unionAll(docs.select("doc_id", "text").mapInArrow(run, schema))
    return found


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.4, least: float = 0.8) -> DataFrame:
    """The documents without a leak, with all their columns."""
    batches_of(docs.sparkSession)
    at, clean = docs.columns.index("text"), docs
    for index in build_indexes(items):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[x[0] for x in _leaks(index, batch.column(at).to_pylist(), threshold, least)]] = False
                yield batch.filter(pa.array(keep))

        clean = clean.mapInArrow(run, docs.schema)
    return clean
