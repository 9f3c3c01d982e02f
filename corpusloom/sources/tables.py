"""Parquet tables, plain text lists and count matrices in coordinate form."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.staging import staged

#: rows that a task sorts when it writes counts
COUNT_ROWS = 2_000_000

COUNT_SCHEMA = "article_id {id}, dim int, n bigint, embedding string"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", by: str | None = None) -> None:
    """Write Parquet; with `by`, one folder per value, and `mode="append"` adds new batches."""
    writer = (df.hint("rebalance", by).write.partitionBy(by) if by else df.write).mode(mode)
    writer.parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): the lines of a text file, or of the files of a folder in the order of their names, numbered from 0.

    The splits of the files are read in parallel and written once. A split's lines are numbered on the spot, and the running
    sums of the splits' sizes, a table of one row per split, give each split its first number.
    """
    split = ["path", "start"]
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")
    )
    lines = staged(lines, "lines")
    before = W.orderBy(*split).rowsBetween(W.unboundedPreceding, -1)
    splits = lines.groupBy(*split).agg(F.count("*").alias("lines"), F.min("at").alias("first"))
    splits = splits.select(*split, "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("offset"))
    return lines.join(splits, split).select((F.col("offset") + F.col("at") - F.col("first")).alias("pos"), "value")


def read_ngrams(spark: SparkSession, path: str) -> DataFrame:
    """The n-gram list file as (pos, ngram) in file order, without empty lines; its order decides which entry wins."""
    return read_lines(spark, path).filter(F.col("value") != "").select(F.col("pos").cast("int").alias("pos"), F.col("value").alias("ngram"))


def ngram_list(ngrams: DataFrame | Sequence[str]) -> list[str]:
    """The ordered list as Python strings; n-gram lists are configuration, not data."""
    if not isinstance(ngrams, DataFrame):
        return list(ngrams)
    return [row.ngram for row in ngrams.orderBy("pos").select("ngram").collect()]


def write_lines(lines: DataFrame, path: str, order: Sequence[str | Column] = (), one_file: bool = False) -> None:
    """Write the first column of `lines`, one value per line, in the given order.

    `one_file` is for short configuration lists; long id lists are sorted and written in parallel.
    """
    if one_file:
        lines = lines.repartition(1)
        lines = lines.sortWithinPartitions(*order) if order else lines
    elif order:
        lines = lines.orderBy(*order)
    lines.select(F.col(lines.columns[0]).cast("string").alias("value")).write.text(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """Count embeddings as (article_id, dim, n), one folder per kind of embedding.

    The kinds are few and their rows compress well, so partitions are sized by rows and not by shuffled bytes.
    """
    rows = counts.select("article_id", "dim", "n", "embedding")
    parts = max(1, math.ceil(rows.count() / COUNT_ROWS))
    rows.repartition(parts, "article_id", "dim").write.partitionBy("embedding").parquet(path)


def read_counts(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    return spark.read.schema(COUNT_SCHEMA.format(id=id_type)).parquet(path)
