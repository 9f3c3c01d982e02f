"""New batch files as they arrive: the append-per-batch form of the article statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.tokens import article_stats
from corpusloom.options import Options
from corpusloom.sources.articles import article_schema


def append_article_stats(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    ngrams: DataFrame | Sequence[str] = (),
    stop: DataFrame | Sequence[str] = (),
    opts: Options = Options(),
) -> StreamingQuery:
    """Append statistics of article files under `path` that earlier runs have not seen.

    The statistics of an article need nothing but its own row, so the stream keeps no state; it stops
    once all present files are done.
    """
    schema = article_schema(opts.id_type).add("batch", "string")
    arriving = spark.readStream.schema(schema).parquet(path)
    stats = article_stats(arriving, ngrams, stop, opts, keep=["batch"])
    return (
        stats.writeStream.format("parquet")
        .partitionBy("batch")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
