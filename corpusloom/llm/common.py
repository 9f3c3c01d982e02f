"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.staging import BATCH_ROWS, bounded_batches, staged

__all__ = ["batches_of", "bytes_of", "held_out", "keyed_groups", "read_table", "staged", "training_rows", "whole_groups"]


def batches_of(spark: SparkSession) -> None:
    """Keep Arrow batches small in rows and bytes, unless the session already asks for still smaller ones."""
    bounded_batches(spark, BATCH_ROWS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(docs: DataFrame, text: str = "text", key: str = "doc_id", *more: str) -> DataFrame:
    """Key and text as UTF-8 bytes (null: empty), and nothing else of the table."""
    batches_of(docs.sparkSession)
    return docs.select(F.col(key), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias(text), *more)


def held_out(key: str = "doc_id"):
    """One row in five, by a checksum of its id; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most `rows` labelled documents (doc_id, text, label) that are not held out.

    Rows are taken in the order of a hash of the id. The ids are broadcast: `rows` bounds them.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def keyed_groups(batches: Iterator[pa.RecordBatch], keys: int, limit: int | None = None) -> Iterator[pa.Table]:
    """The consecutive rows that share their first `keys` columns, from batches that are sorted by them.

    Columns must be integers without nulls in the key. Groups are the caller's to bound.
    """
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        columns = [table.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(table.num_rows - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        ends = np.flatnonzero(change) + 1
        start = 0
        for end in ends.tolist():
            yield table.slice(start, end - start)
            start = end
        rest = table.slice(start)
    if rest is not None and rest.num_rows:
        yield rest


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 50_000) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Many groups at once, never a part of one: where the key changes from the row before, and the columns after the keys.

    About `rows` rows at a time, from batches of integers that are sorted by the key.
    """
    parts: list[list[np.ndarray]] = []
    size = 0

    def cut(last: bool):
        nonlocal parts, size
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        change = np.zeros(size, dtype=bool)
        for c in columns[:keys]:
            change[1:] |= c[1:] != c[:-1]
        end = size if last else int(np.flatnonzero(change)[-1]) if change.any() else 0
        parts, size = [[c[end:] for c in columns]], size - end
        return change[:end], [c[:end] for c in columns[keys:]]

    for batch in batches:
        if batch.num_rows:
            parts.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
        if size >= rows:
            change, columns = cut(False)
            if len(change):
                yield change, columns
    if size:
        yield cut(True)
