"""Tables written between steps, so that later steps neither recompute nor depend on executors."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: rows and bytes of one Arrow batch that a Python worker gets
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20

#: rows of one file of a table whose rows have megabytes: writer and reader hold a hundred and more at once
FILE_ROWS = {"neighbours-within": 16}
#: tables that hold about as much text as the input
COMPRESSION = {"lines-words": "zstd", "distinct-lines": "zstd"}

_local_folders: dict[str, tempfile.TemporaryDirectory] = {}


def stage_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for a local session without it."""
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _local_folders:
        _local_folders[app] = tempfile.TemporaryDirectory(prefix="corpusloom-", ignore_cleanup_errors=True)
    return _local_folders[app].name


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{stage_folder(spark)}/{name}-{uuid4().hex}"


def clear_stage(spark: SparkSession) -> None:
    """Remove all staged tables of this application; results that are still lazy must be written before."""
    _remove(spark, stage_folder(spark))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the stage folder and continue from the written table."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("maxRecordsPerFile", FILE_ROWS.get(name, 0)).option("compression", COMPRESSION.get(name, "snappy")).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def dropped(df: DataFrame) -> None:
    """Remove the folder of a table that `staged` wrote; nothing may read it any more, lazy results neither."""
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        _remove(df.sparkSession, folder)


def released(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what is written: it does so when the driver's garbage is collected."""
    spark.sparkContext._jvm.java.lang.System.gc()


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep what a Python worker holds at a time small, however large the partitions are; a session that asks for less keeps it."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def spread(scan: DataFrame) -> DataFrame:
    """Round-robin the rows of a plain scan that has fewer splits than the session has cores.

    A large table has more splits than cores and comes back unchanged, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(2 * cores)
