"""Exact removal of repeated strings by prefix-free parsing.

Every string of `LENGTH` (200) bytes that starts at two places or more is repeated, and each byte that a repeated string covers
goes. Texts are parsed into phrases at triggers of a rolling hash. A trigger is the place of the least hash of `TRIGGER`
bytes among the places at which it and `CONTEXT` bytes after it lie within a 200-byte string; in this form every such string has exactly one trigger,
the same wherever the string occurs, so equal strings meet at equal triggers (a hash that is 0 modulo a
number would leave strings without any).

The dictionary are the distinct phrases: the bytes of all strings that share one trigger, told apart by a 64-bit
hash within the context of the trigger. The parse is the list of phrases of each document. A context that the parse always follows
with the same phrase, twice or more, repeats all strings of the phrase, without a look at
its bytes. Where one context has different phrases their bytes are fetched, once per distinct
phrase, and the suffixes of the dictionary's phrases are sorted: ranks of 8 bytes are doubled to ranks of 200, which is the suffix array of
the context's part of the dictionary, cut at the length that counts. Strings of one rank are the same string at several places of the dictionary, and
the parse says how often each phrase stands in the corpus. As equal strings share a context, no order beyond a context is
needed, and the work beyond one pass over the texts follows the dictionary, not the copies. Contexts with more than `GROUP` different
phrases are resolved by a shuffle of string hashes instead of within a task.

Matches never cross documents. Null and empty texts are empty. Texts under 200 bytes are kept whole. Repeated rows of an id
are documents of their own, as are rows with a null id. Extra columns are ignored. Very long texts are parsed in overlapping
segments, which only adds phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, keyed_groups, staged

LENGTH = 200
CONTEXT = 48
TRIGGER = 16
PLACES = LENGTH - CONTEXT + 1
#: bytes that are parsed at a time
SEGMENT = 1 << 21
GROUP = 20_000

_LOW = (1 << 24) - 1
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(3).integers(0, 2**64, 256, dtype=np.uint64)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


class Hashes:
    """Hashes of any stretch of some bytes, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(10, int(len(data)).bit_length())
        power, self.inverse = _powers(size)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _ODD
    return x ^ (x >> _SHIFT)


def phrases(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of every phrase of some texts: text, first string start, number of starts, trigger from the first start, context and phrase hash."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - LENGTH + 1, 0)
    if not count.sum():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none, none
    hashes = Hashes(data)
    at = np.arange(len(data) - TRIGGER + 1)
    least = (hashes.of(at, at + TRIGGER) & ~np.uint64(_LOW)) | at.astype(np.uint64)
    wide = 1
    while 2 * wide <= PLACES:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < PLACES:
        least = np.minimum(least[: len(least) - (PLACES - wide)], least[PLACES - wide :])
    text = np.repeat(np.arange(len(texts)), count)
    start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + offsets[text]
    trigger = (least[start] & np.uint64(_LOW)).astype(np.int64)
    new = np.ones(len(text), dtype=bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(text)))
    lo, trigger, text = start[first], trigger[first], text[first]
    context = hashes.of(trigger, trigger + CONTEXT)
    phrase = hashes.of(lo, lo + n - 1 + LENGTH) ^ mix(((trigger - lo) * 1024 + n).astype(np.uint64))
    return text, lo - offsets[text], n, trigger - lo, context.view(np.int64), phrase.view(np.int64)


def _segments(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in lists of about SEGMENT bytes (row, offset, bytes); a longer one in pieces that overlap by LENGTH - 1."""
    rows, bases, held, size = [], [], [], 0
    for row, text in enumerate(texts):
        for base in range(0, max(1, len(text) - LENGTH + 1), SEGMENT):
            piece = text if len(text) <= SEGMENT else text[base : base + SEGMENT + LENGTH - 1]
            if held and size + len(piece) > SEGMENT:
                yield rows, bases, held
                rows, bases, held, size = [], [], [], 0
            rows.append(row)
            bases.append(base)
            held.append(piece)
            size += len(piece)
    if held:
        yield rows, bases, held


def _keyed(docs: DataFrame) -> DataFrame:
    """Id, 128 bits that tell repeated ids with other texts apart, and the text as bytes."""
    batches_of(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select("doc_id", F.unhex(F.md5(text)).alias("mark"), text.alias("text"))


def parse(keyed: DataFrame) -> DataFrame:
    """doc_id, mark, and lo, n, back, context and phrase of every phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, bases, held in _segments(batch.column(2).to_pylist()):
                text, lo, n, back, context, phrase = phrases(held)
                at = pa.array(np.array(rows, dtype=np.int64)[text])
                lo = lo + np.array(bases, dtype=np.int64)[text]
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(lo), pa.array(n.astype(np.int16)), pa.array(back.astype(np.int16)), pa.array(context), pa.array(phrase)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "lo", "n", "back", "context", "phrase"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, mark binary, lo long, n short, back short, context long, phrase long")


def _string_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part, place and hash of every string of the phrases' bytes."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    hashes = Hashes(np.frombuffer(b"".join(parts), dtype=np.uint8))
    count = sizes - LENGTH + 1
    part = np.repeat(np.arange(len(parts)), count)
    place = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)
    start = place + (np.cumsum(sizes) - sizes)[part]
    return part, place, hashes.of(start, start + LENGTH)


def _string_ranks(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part, place and rank in the suffix order of every string of the phrases' bytes."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    count = sizes - LENGTH + 1
    part = np.repeat(np.arange(len(parts)), count)
    place = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)
    start = place + (np.cumsum(sizes) - sizes)[part]
    key = np.zeros(len(data) - 7, dtype=np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | data[k : len(data) - 7 + k]
    rank, wide = np.unique(key, return_inverse=True)[1].astype(np.int64), 8
    while wide < LENGTH:
        step = min(wide, LENGTH - wide)
        # a string's rank follows from those of its first and its last `wide` bytes
        rank = np.unique(rank[:-step] * (rank.max() + 1) + rank[step:], return_inverse=True)[1].astype(np.int64)
        wide += step
    return part, place, rank[start]


def _compare(groups: list[pa.Table]) -> pa.RecordBatch:
    """context, phrase and the ranges of repeated string places (first, last) of phrases that share contexts."""
    table = pa.concat_tables(groups)
    owner = np.repeat(np.arange(len(groups)), [g.num_rows for g in groups])
    times = table.column("times").to_numpy()
    part, place, code = _string_ranks(table.column("bytes").to_pylist())
    order = np.lexsort((code, owner[part]))
    same = np.ones(len(order), dtype=bool)
    o, c = owner[part][order], code[order]
    same[1:] = (o[1:] != o[:-1]) | (c[1:] != c[:-1])
    first = np.flatnonzero(same)
    total = np.add.reduceat(times[part[order]], first)
    again = np.empty(len(order), dtype=bool)
    again[order] = np.repeat(total > 1, np.diff(np.append(first, len(order))))
    begins = again.copy()
    begins[1:] &= ~(again[:-1] & (part[1:] == part[:-1]))
    ends = again.copy()
    ends[:-1] &= ~(again[1:] & (part[1:] == part[:-1]))
    b, e = np.flatnonzero(begins), np.flatnonzero(ends)
    at = pa.array(part[b])
    columns = [table.column("context").combine_chunks().take(at), table.column("phrase").combine_chunks().take(at), pa.array(place[b]), pa.array(place[e])]
    return pa.RecordBatch.from_arrays(columns, ["context", "phrase", "from", "to"])


def _fetch(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """context, phrase, times and the bytes of one occurrence of each wanted phrase."""
    per_doc = wanted.groupBy("at.doc_id", "at.mark").agg(F.collect_list(F.struct("context", "phrase", "times", "at.lo", "at.n")).alias("wanted"))
    per_doc = per_doc.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "wanted")
    joined = keyed.join(per_doc, keyed["doc_id"].eqNullSafe(per_doc["d"]) & (keyed["mark"] == per_doc["m"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(w["context"], w["phrase"], w["times"], text[w["lo"] : w["lo"] + w["n"] - 1 + LENGTH]) for w in held]
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["context", "phrase", "times", "bytes"])

    return joined.select("text", "wanted").mapInArrow(run, "context long, phrase long, times long, bytes binary")


def _resolve(keyed: DataFrame, dictionary: DataFrame, group: int) -> DataFrame:
    """context, phrase, from, to: the repeated strings of phrases whose contexts have several phrases."""
    sizes = dictionary.groupBy("context").agg(F.count(F.lit(1)).alias("phrases"))
    sized = staged(dictionary.join(sizes, "context"), "dictionary")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in keyed_groups(batches, 1):
            held.append(table)
            size += table.num_rows
            if size >= 4000:
                yield _compare(held)
                held, size = [], 0
        if held:
            yield _compare(held)

    # repeated rows of a document bring the same phrase again
    small = _fetch(keyed, sized.where(F.col("phrases") <= group)).dropDuplicates(["context", "phrase"])
    schema = "context long, phrase long, `from` long, `to` long"
    found = small.repartition("context").sortWithinPartitions("context", "phrase").mapInArrow(within, schema)
    large = sized.where(F.col("phrases") > group)
    if large.limit(1).count():

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                part, place, code = _string_hashes(batch.column("bytes").to_pylist())
                at = pa.array(part)
                columns = [*(batch.column(k).take(at) for k in range(3)), pa.array(place), pa.array(code.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["context", "phrase", "times", "place", "code"])

        bytes_ = _fetch(keyed, large).dropDuplicates(["context", "phrase"])
        strings = staged(bytes_.mapInArrow(spread, "context long, phrase long, times long, place long, code long"), "strings")
        again = strings.groupBy("context", "code").agg(F.sum("times").alias("total")).where("total > 1")
        hot = strings.join(again, ["context", "code"]).select("context", "phrase", F.col("place").alias("from"), F.col("place").alias("to"))
        found = found.unionAll(hot)
    return found


def repeated_spans(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, mark and spans (array of start and end in bytes, in order, may overlap) of documents with repeated strings."""
    keyed = _keyed(docs)
    contexts = parse(keyed).groupBy("context").agg(F.count(F.lit(1)).alias("times"), F.min("phrase").alias("low"), F.max("phrase").alias("high"))
    # written, so that Spark can split a context that very many phrases share
    contexts = staged(contexts.where("times > 1").select("context", (F.col("low") != F.col("high")).alias("several")), "contexts")
    hits = parse(keyed).join(contexts, "context")
    hits = hits.select("doc_id", "mark", "lo", "n", F.when(F.col("several"), F.col("context")).alias("context"), F.when(F.col("several"), F.col("phrase")).alias("phrase"))
    hits = staged(hits, "repeated-phrases")
    alone = hits.where("context IS NULL").select("doc_id", "mark", "lo", (F.col("lo") + F.col("n") - 1 + LENGTH).alias("end"))
    mixed = hits.where("context IS NOT NULL")
    dictionary = mixed.groupBy("context", "phrase").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "mark", "lo", "n")).alias("at"))
    ranges = _resolve(keyed, dictionary, group)
    found = mixed.join(ranges, ["context", "phrase"]).select("doc_id", "mark", (F.col("lo") + F.col("from")).alias("lo"), (F.col("lo") + F.col("to") + LENGTH).alias("end"))
    spans = alone.unionAll(found).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("lo", "end"))).alias("spans"))
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlap or touch."""
    out: list[tuple[int, int]] = []
    for lo, end in spans:
        if out and lo <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((lo, end))
    return out


def without_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed and n_spans of every document."""
    keyed = _keyed(docs)
    spans = repeated_spans(docs, group).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "spans")
    joined = keyed.join(spans, keyed["doc_id"].eqNullSafe(spans["d"]) & (keyed["mark"] == spans["m"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone = merged([(s["lo"], s["end"]) for s in spans or ()])
                at, parts = 0, []
                for lo, end in gone:
                    parts.append(text[at:lo])
                    at = end
                parts.append(text[at:])
                kept.append(b"".join(parts))
                rows.append((len(text), sum(e - b for b, e in gone), len(gone)))
            columns = [batch.column(0), pa.array(kept, pa.binary()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")
