"""SimHash near-dedup by multi-index hashing: small Hamming balls within segments, then whole distances.

A fingerprint has 64 bits: a bit is 1 if it is set in more than half of the XXH64 values of a text's word shingles.
Two fingerprints within 3 bits differ by at most one bit in one of their 32-bit halves, so each is filed under
both halves and looked up under every half value within one bit (in the direction 0 to 1, as the
other of a pair looks up the rest). The distinct fingerprints that meet under a half value are compared over all
64 bits. Within a bucket a fingerprint that is already reached from another is not compared again as a
target, so a dense bucket costs little more than its size and emits fewer links than members. Buckets
with more than `BLOCK` members are cut into blocks, and every pair of blocks is a task's group of its
own, which keeps all links with bounded memory.

Copies share a fingerprint and enter once. Null and empty texts have fingerprint zero, which is
linked like any other. Repeated rows keep their own result. Extra columns are ignored. Rows with a null
doc_id get a component but never name one, unless no other row of it has an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from corpusloom.llm.common import batches_of, bytes_of, keyed_groups, staged
from corpusloom.llm.components import components

SEED = 42
SHINGLE = 3
MOST_BITS = 3
BLOCK = 4096
#: shingles counted at a time
CHUNK = 1 << 17


def _digests(text: bytes, width: int) -> list[bytes]:
    words = text.lower().split()
    if not words:
        return []
    if len(words) < width:
        return [xxh64_digest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, n: end + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return [xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)]


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    hashes = _digests(text, width)
    count = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), CHUNK):
        part = np.frombuffer(b"".join(hashes[lo : lo + CHUNK]), dtype=np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * count > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, *more: str) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number) and the columns `more` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]], ["doc_id", "fp", *more])

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more)
    return bytes_of(docs, "text", "doc_id", *more).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long{kinds}")


def _buckets(nodes: DataFrame) -> DataFrame:
    """Half (0 low, 1 high), half value, fp, and whether the fp itself has that half value."""

    def filed(half: int, value) -> DataFrame:
        bits = F.sequence(F.lit(0), F.lit(31))
        flips = F.transform(bits, lambda bit: value.bitwiseOR(F.pow(F.lit(2.0), bit).cast("long")))
        keys = F.concat(F.array(value), F.filter(flips, lambda key: key != value))
        return nodes.select(F.lit(half).alias("half"), F.posexplode(keys).alias("pos", "key"), "fp")

    parts = [filed(0, F.col("fp").bitwiseAND(F.lit((1 << 32) - 1))), filed(1, F.shiftrightunsigned("fp", 32))]
    both = parts[0].unionAll(parts[1])
    return both.select((F.col("key") * 2 + F.col("half")).alias("key"), "fp", (F.col("pos") == 0).alias("own"))


def spanning_links(values: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the values (uint64) under distances of at most `most_bits`."""
    left = np.arange(len(values))
    a, b = [], []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        source = queue.pop()
        near = np.bitwise_count(values[left] ^ values[source]) <= most_bits
        found = left[near]
        if len(found):
            left = left[~near]
            a.append(np.full(len(found), source))
            b.append(found)
            queue.extend(found.tolist())
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def blocked(rows: DataFrame, sizes: DataFrame, key: str, item: str, block: int) -> DataFrame:
    """`rows` of the groups in `sizes` (key, n) with block numbers i <= j; a row joins every pair of its block.

    Groups of up to `block` rows are one block (0, 0).
    """
    n = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(item), F.col("blocks")).cast("int")
    # what is exploded looks as small as what it came from, so Spark would broadcast it
    held = rows.join(sizes.select(key, n.alias("blocks")).hint("merge"), key).withColumn("own", own)
    pairs = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a block meets itself only in the pair with its neighbour, unless it is alone
    pairs = pairs.where((F.col("blocks") == 1) | (F.col("own") != F.col("other")))
    return pairs.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other", "blocks")


def fingerprint_links(nodes: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints; every two within `most_bits` (at most 3) are connected by them."""
    if not 0 <= most_bits <= 3:
        raise ValueError("two halves with balls of one bit find distances of at most 3")
    batches_of(nodes.sparkSession)
    rows = _buckets(nodes)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own")).where("own AND n > 1")
    live = blocked(rows.select("key", "fp"), sizes, "key", "fp", BLOCK)
    sorted_ = live.select("key", "i", "j", "fp").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for group in keyed_groups(batches, 3):
            fp = group.column(3).to_numpy()
            a, b = spanning_links(fp.view(np.uint64), most_bits)
            left.append(fp[a])
            right.append(fp[b])
            if len(left) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])
                left, right = [], []
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return sorted_.mapInArrow(run, "a long, b long")


def _named(found: DataFrame, most_bits: int) -> DataFrame:
    """fp, root (a fingerprint that names its component, also without ids) and component_id of every fingerprint."""
    nodes = staged(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    groups = components(fingerprint_links(nodes.select("fp"), most_bits))
    groups = groups.join(nodes.hint("merge"), groups["node"] == nodes["fp"]).select("fp", "component", "first")
    least = groups.groupBy("component").agg(F.min("first").alias("least"))
    named = nodes.join(groups.join(least.hint("merge"), "component").select("fp", "component", "least").hint("merge"), "fp", "left")
    return named.select("fp", F.coalesce("component", "fp").alias("root"), F.coalesce("least", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id that links reach) of every document."""
    found = staged(fingerprints(docs, width), "fingerprints")
    return found.join(_named(found, most_bits).hint("merge"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_first(docs: DataFrame, width: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """One document of each component, with all its columns: the least doc_id (null: last), then the least hash of the text.

    Of rows with the same id and text one stays.
    """
    mark = "text_mark"
    while mark in docs.columns:
        mark += "_"
    marked = docs.withColumn(mark, F.xxhash64("text"))
    found = staged(fingerprints(marked.select("doc_id", "text", F.col(mark).alias("mark")), width, "mark"), "fingerprints")
    roots = found.join(_named(found, most_bits).select("fp", "root").hint("merge"), "fp")
    # a null id is greater than any other
    first = roots.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("kept_id"), F.col("first.mark").alias("kept_mark"))
    same = marked["doc_id"].eqNullSafe(kept["kept_id"]) & (marked[mark] == kept["kept_mark"])
    return marked.join(kept.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", mark]).drop(mark)
