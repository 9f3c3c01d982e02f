"""Article tables: batch scan, corpus scan, and the views derived from a plain document table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import zero_pad
from corpusloom.staging import spread


def article_schema(id_type: str | None = None) -> T.StructType:
    return T.StructType(
        [
            T.StructField("id", T.LongType() if id_type == "bigint" else T.StringType()),
            T.StructField("title", T.StringType()),
            T.StructField("abstract", T.StringType()),
        ]
    )


def write_batches(articles: DataFrame, path: str) -> None:
    """One folder per batch; the rebalance splits large batches instead of filling one task."""
    articles.hint("rebalance", "batch").write.partitionBy("batch").parquet(path)


def read_batches(spark: SparkSession, path: str, start: int, end: int, id_type: str | None = None) -> DataFrame:
    """Articles of the batches named by four digits from `start` to `end`, both included.

    `batch` is a partition column, so other batches are never opened.
    """
    schema = article_schema(id_type).add("batch", T.StringType())
    batch = F.col("batch")
    return (
        spark.read.schema(schema)
        .parquet(path)
        .filter(batch.rlike("^[0-9]{4}$") & batch.between(f"{start:04}", f"{end:04}"))
    )


def read_corpus(spark: SparkSession, path: str, processing: str = "raw", id_type: str | None = None) -> DataFrame:
    """The whole corpus at one processing level; `processing` is a partition column."""
    schema = article_schema(id_type).add("processing", T.StringType())
    return spark.read.schema(schema).parquet(path).filter(F.col("processing") == processing).drop("processing")


def articles_of(documents: DataFrame) -> DataFrame:
    """Articles from `(doc_id, text)`: first line is the title, the rest the abstract."""
    title = F.substring_index("text", "\n", 1)
    return documents.select(
        F.col("doc_id").alias("id"),
        title.alias("title"),
        F.substr("text", F.length(title) + 2).alias("abstract"),
        zero_pad(F.floor(F.col("doc_id") / 100 + 1), 4).alias("batch"),
    )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    return articles_of(spread(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")))


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df
