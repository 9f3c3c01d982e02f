"""Byte-level BPE of whole texts: each distinct word of the corpus is encoded once and joined back by position.

Texts are split into pre-tokens by the tokenizer's pattern. The documents of a task are taken together in chunks of
about `CHUNK_BYTES`; a chunk is written once, as its distinct words, dealt to `buckets` lists by a checksum, and the sequence of
their numbers, which is each word's position. One shuffle brings the lists of a bucket together, so that all copies of a word meet where it
is encoded, once; a second one takes the ids of each list back to its chunk, where the sequence puts them in
order. What is shuffled are the distinct words of chunks, never single occurrences; a word that stands in every document is one entry
per chunk. The sequences are the bulk and are not shuffled: their table is bucketed by chunk.

Decoding joins ids with the table of token bytes. A table of at most `BROADCAST_TOKENS` tokens is broadcast,
after they are counted; with a larger one single ids are joined and put back by position.

Null and empty texts have no ids. Repeated rows and null ids are texts of their own, as chunks keep rows and not keys. A text
larger than a chunk is a chunk of its own. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, staged
from corpusloom.staging import stage_path

CHUNK_BYTES = 8 << 20
#: lists of words that a chunk has at least
MIN_BUCKETS = 64
#: words whose ids a task remembers
REMEMBERED = 1_000_000
#: tokens up to which their table is broadcast; the longest token bounds its bytes
BROADCAST_TOKENS = 1_000_000
#: characters from which the words of a text are taken one by one instead of as one list
LONG_TEXT = 1 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


@cache
def _merges(path: str, pattern: str):
    """Ids of one word; a worker reads the ranks once."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})._core_bpe.encode_single_piece


@cache
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


class _Numbers(dict):
    """Numbers of symbols in the order of their first use."""

    def __missing__(self, symbol):
        self[symbol] = n = len(self)
        return n


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 by their lowest, second, ... bytes, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(numbers).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], 4 * n, "zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def packed_strings(strings: list[bytes]) -> bytes:
    sizes, data = packed(np.array([len(s) for s in strings], dtype=np.uint32)), b"".join(strings)
    return len(sizes).to_bytes(4, "little") + sizes + pa.compress(data, "zstd", asbytes=True)


def unpacked_strings(data: bytes) -> tuple[np.ndarray, bytes]:
    """Sizes, and the bytes of all strings."""
    n = int.from_bytes(data[:4], "little")
    sizes = unpacked(data[4 : 4 + n])
    return sizes, pa.decompress(data[4 + n :], int(sizes.sum(dtype=np.int64)), "zstd", asbytes=True)


def _chunks(words, limit: int, buckets: int):
    """Rows (key, content) as chunks: keys, numbers of words, the sequence of word numbers, and the words.

    Words are numbered from the most frequent on; `place` is a word's place in the lists, which are sorted.
    """
    names = ["chunk", "keys", "sizes", "codes", "place", "lists"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, kind = TaskContext.get().partitionId() << 32, 0, None
        known, codes, keys, sizes, held = _Numbers(), array("I"), [], [], 0

        def out() -> pa.RecordBatch:
            data = np.frombuffer(codes, dtype=np.uint32)
            by_use = np.argsort(-np.bincount(data, minlength=len(known)), kind="stable")
            number = np.empty(len(known), dtype=np.int64)
            number[by_use] = np.arange(len(known))
            strings = [w.encode() for w in known]
            lists: list[list] = [[] for _ in range(buckets)]
            for k, w in enumerate(strings):
                lists[crc32(w) % buckets].append((w, k))
            for own in lists:
                own.sort()
            order = np.fromiter((k for own in lists for _, k in own), dtype=np.int64, count=len(known))
            place = np.empty(len(known), dtype=np.int64)
            place[number[order]] = np.arange(len(known))
            columns = [
                pa.array([base + made]),
                pa.array([keys], pa.list_(kind)),
                pa.array([packed(np.array(sizes, dtype=np.uint32))], pa.binary()),
                pa.array([packed(number[data])], pa.binary()),
                pa.array([packed(place)], pa.binary()),
                pa.array([[packed_strings([w for w, _ in own]) for own in lists]], pa.list_(pa.binary())),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            kind = batch.column(0).type
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before = len(codes)
                codes.extend(map(known.__getitem__, words(content)))
                keys.append(key)
                sizes.append(len(codes) - before)
                held += len(content)
                if held >= limit:
                    yield out()
                    known, codes, keys, sizes, held = _Numbers(), array("I"), [], [], 0
                    made += 1
        if keys:
            yield out()

    return run


def _ragged(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of `data` that begin at `starts`, one after the other."""
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0)
    return data[at + np.repeat(starts - (ends - sizes), sizes)]


def _stretches(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and sizes of a binary column, in units of `width` bytes."""
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    buffer = values.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8)[: offsets[-1] // width * width] if buffer else np.zeros(0, dtype=np.uint8)
    return data.view({1: np.uint8, 4: np.uint32}[width]), offsets[:-1] // width, np.diff(offsets) // width


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of consecutive stretches of `data`, whose sizes are in its units."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _encoded(path: str, pattern: str):
    """The lists of words of a bucket as lists of ids; a word is encoded when it is met first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = _merges(path, pattern)
        known: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                if len(known) > REMEMBERED:
                    known.clear()
                sizes, whole = unpacked_strings(data)
                ids, at = [], 0
                for n in sizes.tolist():
                    word = whole[at : at + n]
                    at += n
                    own = known.get(word)
                    if own is None:
                        own = known[word] = array("I", merge(word)).tobytes()
                    ids.append(own)
                flat = np.frombuffer(b"".join(ids), dtype="<u4")
                lengths = packed(np.array([len(i) >> 2 for i in ids], dtype=np.uint32))
                out.append(len(lengths).to_bytes(4, "little") + lengths + packed(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["of", "bucket", "ids"])

    return run


def _reassemble(key: str):
    """One chunk and the ids of its lists to a row per key."""

    def run(chunk: pa.Table, lists: pa.Table) -> pa.Table:
        codes, place, sizes = (unpacked(chunk.column(c)[0].as_py()) for c in ("codes", "place", "sizes"))
        lengths, ids = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.uint32)]
        for data in lists.sort_by("bucket").column("ids").to_pylist():
            n = int.from_bytes(data[:4], "little")
            lengths.append(unpacked(data[4 : 4 + n]))
            ids.append(unpacked(data[4 + n :]))
        lengths, ids = np.concatenate(lengths).astype(np.int64), np.concatenate(ids)
        starts = np.cumsum(lengths) - lengths
        at = place[codes]
        passed = np.concatenate([[0], np.cumsum(lengths[at])])
        ends = np.cumsum(sizes, dtype=np.int64)
        keys = chunk.column("keys").combine_chunks().flatten()
        return pa.table({key: keys, "ids": _binary(_ragged(ids, starts[at], lengths[at]), passed[ends] - passed[ends - sizes])})

    return run


def bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """Write `df` once in the stage folder, bucketed by a column, so that joins on it need not shuffle it."""
    spark = df.sparkSession
    name = f"corpusloom_{uuid4().hex}"
    df.write.bucketBy(buckets, by).option("path", stage_path(spark, name)).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids) of every whole text, ids as little-endian unsigned 32-bit numbers."""
    spark = docs.sparkSession
    path, pattern = path or tokenizer_path(), pattern or split_pattern()
    batches_of(spark)
    kind = docs.schema[key].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def words(content: str):
        find = _splitter(pattern)
        return find.findall(content) if len(content) < LONG_TEXT else (m.group() for m in find.finditer(content))

    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("content"))
    schema = f"chunk long, keys array<{kind}>, sizes binary, codes binary, place binary, lists array<binary>"
    chunks = bucketed(rows.mapInArrow(_chunks(words, CHUNK_BYTES, max(MIN_BUCKETS, parts)), schema), "chunk", parts)
    lists = chunks.select("chunk", F.posexplode("lists").alias("bucket", "words")).repartition("bucket").sortWithinPartitions("bucket")
    ids = lists.select(F.col("chunk").alias("of"), "bucket", "words").mapInArrow(_encoded(path, pattern), "of long, bucket int, ids binary")
    bare = chunks.select("chunk", "keys", "sizes", "codes", "place")
    return bare.groupBy("chunk").cogroup(ids.groupBy("of")).applyInArrow(_reassemble(key), f"`{key}` {kind}, ids binary")


def token_bytes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, token) of all tokens of a rank file; its size is the vocabulary's."""
    ranks = read_ranks(path or tokenizer_path())
    return spark.createDataFrame(pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "token": pa.array(list(ranks), pa.binary())}))


def decode(ids: DataFrame, tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded): the bytes of every row's ids. An id that the table (id, token) lacks is an error."""
    kind = ids.schema[key].dataType.simpleString()
    if tokens.count() > BROADCAST_TOKENS:
        return _decode_joined(ids, tokens, key)
    table = tokens.select("id", "token").toArrow()
    at = table.column("id").to_numpy()
    data, starts, sizes = _stretches(table.column("token").combine_chunks(), 1)
    place = np.full(int(at.max(initial=-1)) + 2, -1, dtype=np.int64)
    place[at] = np.arange(len(at))
    shared = ids.sparkSession.sparkContext.broadcast((place, data, starts, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, data, starts, sizes = shared.value
        for batch in batches:
            content = [i or b"" for i in batch.column(1).to_pylist()]
            wanted = np.frombuffer(b"".join(content), dtype="<u4")
            row = place[np.minimum(wanted, len(place) - 1)]
            if (row < 0).any():
                raise ValueError(f"no bytes for id {wanted[row < 0][0]}")
            passed = np.concatenate([[0], np.cumsum(sizes[row])])
            ends = np.cumsum([len(c) // 4 for c in content])
            decoded = _binary(_ragged(data, starts[row], sizes[row]), np.diff(np.concatenate([[0], passed[ends]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), decoded], [key, "ids", "decoded"])

    return ids.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, ids binary, decoded binary")


def _decode_joined(ids: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """The same by a join of single ids with a table of any size; rows are numbered and written once."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [np.frombuffer(i or b"", dtype="<u4").astype(np.int64) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.list_(pa.int64()))], ["row", "numbers"])

    rows = staged(ids.select(key, "ids").withColumn("row", F.monotonically_increasing_id()), "rows")
    single = rows.select("row", "ids").mapInArrow(numbers, "row long, numbers array<long>").select("row", F.posexplode("numbers").alias("at", "id"))
    found = single.join(tokens.select(F.col("id").cast("long").alias("id"), "token"), "id", "left")
    token = F.coalesce("token", F.raise_error(F.concat(F.lit("no bytes for id "), F.col("id").cast("string"))).cast("binary"))
    in_order = F.sort_array(F.collect_list(F.struct("at", token.alias("token"))))
    whole = found.groupBy("row").agg(F.aggregate(in_order, F.lit(b""), lambda s, x: F.concat(s, x["token"])).alias("decoded"))
    return rows.join(whole, "row", "left").select(key, "ids", F.coalesce("decoded", F.lit(b"")).alias("decoded"))
