"""Spelling variants: words one edit apart, found in k-d trees over their letter counts.

A word is a vector of letter counts. One replaced letter takes one from a count and adds one to another, one
inserted letter adds one, so near words lie within an L1 distance of two. Words of each length are dealt to the cells
of a k-d tree whose planes come from a bounded sample (`SAMPLE_WORDS`, which only balances the cells). Each word
also goes, as a query, to those cells of its own length and of the next one whose boxes an edit can reach. A cell
builds a k-d tree of its own words; its queries prune boxes down to leaves, and the pairs left there are compared letter by
letter. So every pair of lengths is searched, every near pair is found, and no cell lists pairs of words that are far apart.
Links leave a cell as a count and the best neighbour per word, not as pairs.

Null and empty texts have no words. Repeated rows of an id are read each on its own; a null id is the empty string
before the colon. Extra columns are ignored. Very long texts are counted in one pass. Equal counts are
decided by code-point order. An empty table gives no words. Words with the same letters share a
vector, which no plane divides: such a cell may exceed `CELL_WORDS` and is then worked off in blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, staged

MIN_LETTERS = 5
MIN_COUNT = 3
#: one run in so many, by checksum, loses a letter
DAMAGE = 97
#: words whose vectors choose the planes between cells
SAMPLE_WORDS = 20_000
CELL_WORDS = 16_384
LEAF_WORDS = 128
#: words that are dealt to cells at a time
DEALT_WORDS = 20_000
#: distinct words that a task counts before it passes them on
HELD_WORDS = 150_000
#: numbers that one block of comparisons holds
BLOCK = 1 << 20
#: queries that go down a tree together
ASKED_WORDS = 8192

DIMS = 32
_RUN = re.compile("[a-zÀ-ÿ]+")
#: counts as bits set from the lowest on, so that differing bits count differing letters; 8 and more are one
_SIGNS = np.array([(1 << k) - 1 for k in range(9)], dtype=np.uint8)
_DIM = np.array([c - 97 if 97 <= c <= 122 else 26 + c % (DIMS - 26) for c in range(256)])
#: letters that a same-length word and a longer word have beyond a query, at most, and lack
_EDITS = ((1, 1), (1, 0))


def damaged_runs(key: str, text: str) -> Iterator[tuple[str, int]]:
    """Words of a text and their counts, each run under its checksum's decision to lose a letter."""
    start = crc32(f"{key}:".encode())
    for run, n in Counter(_RUN.findall(text)).items():
        h = crc32(run.encode(), start)
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words of whole texts, counted within tasks before they are shuffled."""
    batches_of(docs.sparkSession)
    most = HELD_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # bytes.lower changes A-Z alone
                for word, n in damaged_runs(key, text.lower().decode()):
                    if len(word) >= min_letters:
                        held[word] = held.get(word, 0) + n
                if len(held) >= most:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    parts = rows.mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letter_counts(words: list[str]) -> np.ndarray:
    """Counts of a to z, and of the other letters by their code modulo 6 (words x DIMS)."""
    out = np.zeros((len(words), DIMS), dtype=np.int32)
    for k in range(0, len(words), ASKED_WORDS):
        some = words[k : k + ASKED_WORDS]
        codes = np.frombuffer("".join(some).encode("latin-1"), dtype=np.uint8)
        cells = np.repeat(np.arange(len(some)), [len(w) for w in some]) * DIMS + _DIM[codes]
        out[k : k + ASKED_WORDS] = np.bincount(cells, minlength=len(some) * DIMS).reshape(len(some), DIMS)
    return out


def signature(counts: np.ndarray) -> np.ndarray:
    """The counts of a word as 256 bits: two words differ in at most as many bits as letters."""
    return _SIGNS[np.minimum(counts, 8)].view(np.uint64)


class Tree:
    """A k-d tree. `lo` and `hi` are the nodes' boxes: of their points if `tight`, else what the planes leave."""

    def __init__(self, points: np.ndarray, leaf: int, tight: bool):
        far = np.iinfo(np.int32).max // 4
        self.lo, self.hi, self.children, self.points = [], [], [], []
        whole = (np.full(DIMS, -far), np.full(DIMS, far))
        waiting = [(np.arange(len(points)), whole, -1)]
        while waiting:
            own, (lo, hi), parent = waiting.pop()
            at = len(self.lo)
            if parent >= 0:
                self.children[parent].append(at)
            least, most = (points[own].min(axis=0), points[own].max(axis=0)) if len(own) else whole
            self.lo.append(least if tight else lo)
            self.hi.append(most if tight else hi)
            self.children.append([])
            self.points.append(own)
            if len(own) <= leaf or (least == most).all():
                continue
            dim = int(np.where(most > least, points[own].var(axis=0), -1).argmax())
            values = points[own, dim]
            plane = min(int(np.partition(values, len(values) // 2)[len(values) // 2]), int(most[dim]) - 1)
            below, above = hi.copy(), lo.copy()
            below[dim], above[dim] = plane, plane + 1
            waiting += [(own[values > plane], (above, hi), at), (own[values <= plane], (lo, below), at)]
        self.lo, self.hi = np.array(self.lo, dtype=np.int32), np.array(self.hi, dtype=np.int32)

    def reach(self, queries: np.ndarray, more: int, less: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves, and the queries that reach their box by adding at most `more` letters and taking at most `less`."""
        waiting = [(0, np.arange(k, min(k + ASKED_WORDS, len(queries)))) for k in range(0, len(queries), ASKED_WORDS)]
        while waiting:
            at, own = waiting.pop()
            q = queries[own]
            up = np.maximum(self.lo[at] - q, 0).sum(axis=1)
            down = np.maximum(q - self.hi[at], 0).sum(axis=1)
            own = own[(up <= more) & (down <= less)]
            if not len(own):
                continue
            if self.children[at]:
                waiting += [(c, own) for c in self.children[at]]
            else:
                yield at, own


def _planes(vocabulary: DataFrame, sample_words: int, cell_words: int) -> dict[int, Tree]:
    """A tree per length over the sampled words; lengths that the sample lacks have one cell."""
    total = vocabulary.count()
    share = min(1.0, sample_words / max(total, 1))
    slots = 1 << 40
    some = vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(slots)) < int(slots * share)).select("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            vectors = pa.array(list(letter_counts(words)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in words], pa.int32()), vectors], ["size", "vector"])

    by_size: dict[int, list] = {}
    for row in some.mapInArrow(run, "size int, vector array<int>").toLocalIterator():
        by_size.setdefault(row["size"], []).append(row["vector"])
    leaf = max(1, int(cell_words * share))
    return {size: Tree(np.array(sorted(vectors), dtype=np.int32), leaf, tight=False) for size, vectors in by_size.items()}


def _dealt(planes: dict[int, Tree]):
    """size, cell, role (0: a word of the cell; 1, 2: a query of the same length, of one less), word, n."""
    alone = Tree(np.zeros((0, DIMS), dtype=np.int32), 1, tight=False)

    def deal(table: pa.Table) -> Iterator[pa.RecordBatch]:
        words = table.column(0).to_pylist()
        sizes = np.array([len(w) for w in words])
        vectors = letter_counts(words)
        found = []
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            for role, target, (more, less) in ((0, size, (0, 0)), (1, size, _EDITS[0]), (2, size + 1, _EDITS[1])):
                for cell, at in planes.get(target, alone).reach(vectors[own], more, less):
                    found.append((np.full(len(at), target), np.full(len(at), cell), np.full(len(at), role), own[at]))
        size, cell, role, at = (np.concatenate(x) for x in zip(*found))
        fixed = [pa.array(x.astype(np.int32)) for x in (size, cell, role)]
        dealt = pa.table([*fixed, table.column(0).take(pa.array(at)), table.column(1).take(pa.array(at))], ["size", "cell", "role", "word", "n"])
        yield from dealt.combine_chunks().to_batches(max_chunksize=100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= DEALT_WORDS:
                yield from deal(pa.Table.from_batches(held))
                held, rows = [], 0
        if held:
            yield from deal(pa.Table.from_batches(held))

    return run


def _letters(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def _one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows of letters that differ by exactly one replaced letter, or one inserted into `short`."""
    n = short.shape[1]
    if n == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    head = np.cumprod(short == long[:, :n], axis=1, dtype=np.int8).sum(axis=1)
    tail = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1)
    return head + tail >= n


def near_in_cell(tree: Tree, points: np.ndarray, letters: np.ndarray, queries: np.ndarray, query_letters: np.ndarray, more: int, less: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) of the near words, in blocks."""
    point_signs = signature(points)
    rows = max(1, BLOCK // letters.shape[1])
    for leaf, found in tree.reach(queries, more, less):
        own = tree.points[leaf]
        for first in range(0, len(own), 1024):
            part = own[first : first + 1024]
            signs = point_signs[part]
            step = max(1, BLOCK // len(part))
            for begin in range(0, len(found), step):
                some = found[begin : begin + step]
                asked = signature(queries[some])
                apart = sum(np.bitwise_count(asked[:, None, k] ^ signs[None, :, k]) for k in range(signs.shape[1]))
                q, p = np.nonzero(apart <= more + less)
                q, p = some[q], part[p]
                for k in range(0, len(q), rows):
                    a, b = q[k : k + rows], p[k : k + rows]
                    edit = _one_edit(query_letters[a], letters[b])
                    yield a[edit], b[edit]


def _search(table: pa.Table) -> pa.Table:
    """word, n_near, and the most frequent near word with its count, over the near pairs of one cell."""
    role = table.column("role").to_numpy()
    words, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
    own = np.flatnonzero(role == 0)
    links = []
    if len(own):
        points, letters = letter_counts([words[k] for k in own]), _letters([words[k] for k in own])
        tree = Tree(points, LEAF_WORDS, tight=True)
        for kind in (1, 2):
            asked = np.flatnonzero(role == kind)
            if not len(asked):
                continue
            texts = [words[k] for k in asked]
            for a, b in near_in_cell(tree, points, letters, letter_counts(texts), _letters(texts), *_EDITS[kind - 1]):
                links.append((asked[a], own[b]))
                if kind == 2:  # words of one length find each other from both sides
                    links.append((own[b], asked[a]))
    word = np.concatenate([a for a, _ in links]) if links else np.zeros(0, dtype=np.int64)
    near = np.concatenate([b for _, b in links]) if links else np.zeros(0, dtype=np.int64)
    place = np.empty(len(words), dtype=np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[near], -counts[near], word))
    word, near = word[order], near[order]
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]][: len(word)])
    times = np.diff(np.append(first, len(word)))
    text = table.column("word").combine_chunks()
    best = near[first]
    return pa.table({"word": text.take(pa.array(word[first])), "n_near": pa.array(times.astype(np.int64)), "near_n": pa.array(counts[best].astype(np.int64)), "near": text.take(pa.array(best))})


def near_words(vocabulary: DataFrame, sample_words: int = SAMPLE_WORDS, cell_words: int = CELL_WORDS) -> DataFrame:
    """word, n_near, near_n and near of every word of (word, n) that has a near word; words must be distinct."""
    dealt = vocabulary.select("word", "n").mapInArrow(_dealt(_planes(vocabulary, sample_words, cell_words)), "size int, cell int, role int, word string, n long")
    found = dealt.groupBy("size", "cell").applyInArrow(_search, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) without null forms: the last word that forms lead to.

    A form is at least twice as frequent as its word, so paths are short; each round doubles the steps.
    """
    paths = staged(forms.select("word", F.col("form").alias("root")), "paths")
    while True:
        step = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        paths = staged(paths.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "paths")
        if not paths.where("moved").limit(1).count():
            return paths.select("word", "root")


def variant_forms(docs: DataFrame, sample_words: int = SAMPLE_WORDS, cell_words: int = CELL_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents."""
    vocabulary = staged(word_counts(docs), "vocabulary")
    near = near_words(vocabulary, sample_words, cell_words)
    strong = F.col("near_n") >= 2 * F.col("n")
    words = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("near")).alias("form"), F.when(strong, F.col("near_n")).alias("form_n")
    )
    words = staged(words, "words")
    roots = follow(words.where("form IS NOT NULL"))
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
