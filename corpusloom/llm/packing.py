"""Packing: deficit round-robin over source queues fills every window to target token proportions.

Documents wait in one queue per source, as streams of token ids. A source earns its share of every window
and is served whole tokens; what it is owed is its deficit, carried to the next window. Serving always
the token that is owed the longest gives each source, after any number of served tokens, its exact share within a
token. So the state of the round-robin at any window, deficits included, is a function of the
totals alone (`Schedule.served`): any partition can start at any window with the deficits that all
windows before it have left, and no state passes through one task. When a queue runs dry the others
go on in their proportions (a new phase). Every full window holds `WINDOW` tokens; the remainder of the
whole corpus goes to sequences of falling powers of two, so nothing is padded.

Two passes: texts are tokenized once and written (ids, and the place among the tokens of the same source within the
task); the totals per task and source, a small table, give every document its place in its queue,
from which its pieces follow. The driver holds one total per source.

Null and empty texts are the end id alone. A null source shares the queue of the empty one. Repeated rows are
packed each on its own. Extra columns are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of
from corpusloom.staging import stage_path

WINDOW = 4096
END_ID = 2
#: rows (source, task) up to which their table of a few bytes each is broadcast, after they are counted
BROADCAST_ROWS = 200_000
#: words whose ids a worker remembers
REMEMBERED = 1_000_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts under a tokenizer that never joins what ASCII white space separates.

    Each distinct word is encoded once and remembered as bytes; a text is the concatenation of its words.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = "H" if self.kind is np.uint16 else "I"
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def __call__(self, texts: list[bytes], end: int) -> list[bytes]:
        if len(self.known) > REMEMBERED:  # words that are seen again move over, the others go at the next turn
            self.known, self.older = {}, self.known
        known, split = self.known, [t.split() for t in texts]
        found = [list(map(known.get, words)) for words in split]
        new = {w for words, ids in zip(split, found, strict=True) if None in ids for w, i in zip(words, ids, strict=True) if i is None}
        if self.older:
            known.update((w, self.older[w]) for w in new if w in self.older)
        missing = [w for w in new if w not in known]
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in missing], add_special_tokens=False)
        known.update((w, array(self.code, e.ids).tobytes()) for w, e in zip(missing, encoded, strict=True))
        tail = array(self.code, [end]).tobytes()
        return [
            b"".join([known[w] if i is None else i for w, i in zip(words, ids, strict=True)]) + tail
            for words, ids in zip(split, found, strict=True)
        ]


@cache
def _encoder(path: str) -> WordIds:
    """One for all tasks of a Python worker, so that words learned in one serve the next."""
    return WordIds(path)


def _due_by(within: np.ndarray, count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """floor(within * count / size + 1/2) without rounding: tokens of a source that are due by `within / size`.

    The quotient of floats is off by less than one; the remainder that the wrapped 64-bit product leaves puts it right.
    """
    guess = np.floor(within * (count / size) + 0.5).astype(np.int64)
    left = 2 * within * count + size - guess * 2 * size
    return np.clip(guess + np.floor_divide(left, 2 * size), 0, count)


def _extreme(due: np.ndarray, token: np.ndarray, count: np.ndarray, sign: int) -> np.ndarray:
    """Per row the column that is due first (`sign` 1; ties: first column) or last (-1; ties: last column).

    Floats that are too near to tell apart are compared again as fractions.
    """
    due = due * sign
    n = due.shape[1]
    best = due.argmin(axis=1) if sign > 0 else n - 1 - due[:, ::-1].argmin(axis=1)
    if n > 1:
        least = due.min(axis=1)
        close = due <= (least + np.abs(least) * 1e-12)[:, None]
        for r in np.flatnonzero(close.sum(axis=1) > 1).tolist():
            at = np.flatnonzero(close[r]).tolist()
            best[r] = min(at, key=lambda s: (sign * Fraction(2 * int(token[r, s]) + 1, 2 * int(count[r, s])), sign * s))
    return best


@dataclass(frozen=True)
class Schedule:
    """What every source has been served after any number of tokens.

    `rank[p]` tokens were served before phase `p`, `taken[p, s]` of them from source `s`, which gives
    `count[p, s]` more within the phase.
    """

    rank: np.ndarray
    taken: np.ndarray
    count: np.ndarray
    total: int
    tail: np.ndarray

    @classmethod
    def of(cls, totals: list[int], targets: list[float] | None = None) -> Schedule:
        """Phases for the tokens per source and their target weights (none: their share of all tokens)."""
        left = np.array(totals, dtype=np.int64)
        weight = np.array(totals if targets is None else targets, dtype=float)
        total, rank, taken, count = int(left.sum()), [], [], []
        done = np.zeros_like(left)
        while left.sum():
            live = (left > 0) & (weight > 0)
            if not live.any():  # only sources without a target are left
                weight, live = left.astype(float), left > 0
            time = np.where(live, left / np.where(live, weight, 1), np.inf)
            take = np.where(live, np.minimum(left, np.rint(weight * time.min()).astype(np.int64)), 0)
            take = np.where(time <= time.min() * (1 + 1e-12), left, take)
            rank.append(int(done.sum()))
            taken.append(done.copy())
            count.append(take)
            done, left = done + take, left - take
        rest, parts = total % WINDOW, []
        while rest:
            parts.append(1 << (rest.bit_length() - 1))
            rest -= parts[-1]
        shape = (len(rank), len(totals))
        return cls(np.array(rank, dtype=np.int64), np.array(taken, dtype=np.int64).reshape(shape), np.array(count, dtype=np.int64).reshape(shape), total, np.array(parts, dtype=np.int64))

    @property
    def sequences(self) -> int:
        return self.total // WINDOW + len(self.tail)

    def bound(self, k: np.ndarray) -> np.ndarray:
        """Tokens before sequence `k`."""
        full = self.total // WINDOW
        ends = np.concatenate([[0], np.cumsum(self.tail)])
        return np.minimum(k, full) * WINDOW + ends[np.clip(k - full, 0, len(self.tail))]

    def sequence_of(self, rank: np.ndarray) -> np.ndarray:
        full = self.total // WINDOW
        ends = full * WINDOW + np.cumsum(self.tail)
        return np.where(rank < full * WINDOW, rank // WINDOW, full + np.searchsorted(ends, rank, side="right"))

    def served(self, rank: np.ndarray) -> np.ndarray:
        """Tokens of each source among the first `rank` served (ranks x sources)."""
        phase = np.maximum(np.searchsorted(self.rank, rank, side="right") - 1, 0)
        count, size = self.count[phase], self.count.sum(axis=1)[phase]
        within = rank - self.rank[phase]
        scale = np.where(count > 0, count, 1).astype(float)
        got = _due_by(within[:, None], count, size[:, None])
        off = within - got.sum(axis=1)
        while off.any():
            # the j-th token of a source is due at (j + 1/2) / count; ties go to the first source
            more, less = np.flatnonzero(off > 0), np.flatnonzero(off < 0)
            due = np.where(got[more] < count[more], (got[more] + 0.5) / scale[more], np.inf)
            got[more, _extreme(due, got[more], count[more], 1)] += 1
            last = np.where(got[less] > 0, (got[less] - 0.5) / scale[less], -np.inf)
            got[less, _extreme(last, got[less] - 1, count[less], -1)] -= 1
            off = within - got.sum(axis=1)
        return self.taken[phase] + got

    def holder(self, source: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The sequence that holds token `place` of a source: the last one before which at most `place` were served."""

        def before(k: np.ndarray) -> np.ndarray:
            needed, at = np.unique(k, return_inverse=True)
            return self.served(self.bound(needed))[at, source]

        guess = self.sequence_of(self.near(source, place))
        low, high = np.maximum(guess - 1, 0), np.minimum(guess + 2, self.sequences)
        low = np.where(before(low) <= place, low, 0)
        high = np.where(before(high) > place, high, self.sequences)
        while (high - low > 1).any():
            middle = (low + high) // 2
            fits = before(middle) <= place
            low, high = np.where(fits, middle, low), np.where(fits, high, middle)
        return low

    def near(self, source: np.ndarray, place: np.ndarray) -> np.ndarray:
        """About the rank at which token `place` of a source is served."""
        out = np.zeros(len(place), dtype=np.int64)
        for s in np.unique(source):
            own = source == s
            phase = np.searchsorted(self.taken[:, s], place[own], side="right") - 1
            share = (place[own] - self.taken[phase, s]) / np.maximum(self.count[phase, s], 1)
            out[own] = self.rank[phase] + (share * self.count.sum(axis=1)[phase]).astype(np.int64)
        return out


def _tokenize(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        passed: dict[str, int] = {}
        for batch in batches:
            ids = encode(batch.column("text").to_pylist(), end)
            size = np.dtype(encode.kind).itemsize
            counts = [len(i) // size for i in ids]
            at = []
            for queue, n in zip(batch.column("queue").to_pylist(), counts, strict=True):
                at.append(passed.get(queue, 0))
                passed[queue] = at[-1] + n
            columns = [batch.column("doc_id"), batch.column("queue"), batch.column("part"), pa.array(at), pa.array(counts), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "queue", "part", "at", "n", "ids"])

    return run


def _cut(schedule: Schedule, queues: list[str], wide: bool):
    index = {q: k for k, q in enumerate(queues)}
    kind = np.uint32 if wide else np.uint16
    names = ["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            source = np.array([index[q] for q in batch.column("queue").to_pylist()])
            first, n = batch.column("first").to_numpy(), batch.column("n").to_numpy()
            low, high = schedule.holder(source, first), schedule.holder(source, first + n - 1)
            tries = high - low + 1
            row = np.repeat(np.arange(len(n)), tries)
            sequence = np.arange(len(row)) - np.repeat(np.cumsum(tries) - tries, tries) + low[row]
            needed, place = np.unique(np.concatenate([sequence, sequence + 1]), return_inverse=True)
            served = schedule.served(schedule.bound(needed))
            opens, closes = place[: len(row)], place[len(row) :]
            s = source[row]
            begin = np.maximum(first[row], served[opens, s])
            end = np.minimum(first[row] + n[row], served[closes, s])
            keep = np.flatnonzero(end > begin)
            row, sequence, s, begin, end, opens, closes = (a[keep] for a in (row, sequence, s, begin, end, opens, closes))
            before = np.concatenate([np.zeros((len(needed), 1), dtype=np.int64), np.cumsum(served, axis=1)], axis=1)
            offset = before[closes, s] - before[opens, s] + begin - served[opens, s]
            start, length = begin - first[row], end - begin
            ids = [np.frombuffer(i, dtype=kind).astype("<u4") for i in batch.column("ids").to_pylist()]
            pieces = [ids[r][a : a + k].tobytes() for r, a, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            at = pa.array(row)
            columns = [batch.column("doc_id").take(at), batch.column("queue").take(at), *map(pa.array, (start, length)), pa.array(pieces, pa.binary()), *map(pa.array, (n[row], sequence, offset))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack(docs: DataFrame, targets: Mapping[str, float] | None = None, path: str | None = None, end: int = END_ID) -> DataFrame:
    """Pieces of all documents: where each lies in its document and in its sequence, and its ids.

    `targets` are the weights of the sources in every window, by default their share of all tokens, at which all
    queues run dry together; sources without a weight come after the others. `ids` are little-endian
    unsigned 32-bit numbers.
    """
    spark = docs.sparkSession
    batches_of(spark)
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"),
        F.spark_partition_id().alias("part"),
    )
    schema = f"doc_id {kind}, queue string, part int, at long, n long, ids binary"
    folder = stage_path(spark, "tokens")
    rows.mapInArrow(_tokenize(path, end), schema).write.option("compression", "zstd").parquet(folder)
    tokens = spark.read.schema(schema).parquet(folder)
    sums = tokens.groupBy("queue", "part").agg(F.sum("n").alias("sum"))
    totals = sorted((r.queue, r.total) for r in sums.groupBy("queue").agg(F.sum("sum").alias("total")).collect())
    queues = [q for q, _ in totals]
    weights = None if targets is None else [targets.get(q, 0.0) for q in queues]
    schedule = Schedule.of([t for _, t in totals], weights)
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("queue", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    if sums.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, ["queue", "part"]).select("doc_id", "queue", (F.col("base") + F.col("at")).alias("first"), "n", "ids")
    wide = WordIds(path).kind is np.uint32
    pieces = f"doc_id {kind}, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(_cut(schedule, queues, wide), pieces)


def with_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")
