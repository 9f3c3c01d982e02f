"""Feather (Arrow IPC file) tables.

`read_feather` and `write_feather` work on the cluster's file system: Spark's own scan lists and reads the files, and
a path without a scheme belongs to `fs.defaultFS`, for the driver and the tasks alike. All files must have one schema. Tasks write
files of bounded size under a temporary name, and the driver renames those of the successful attempts through Hadoop's file
system when all tasks are done.

`spark.read.format("feather")` is the same as a data source for paths that Arrow's file systems open; a path without a scheme is
then a path of each machine, so give a URI or a shared mount.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from uuid import uuid4

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from corpusloom.staging import bounded_batches

BATCHES_PER_SPLIT = 16
#: bytes after which a task begins a new file; a reading task holds a whole file, as Spark reads it as one value of at most 2 GB
FILE_BYTES = 16 << 20


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[str]:
    """Feather files at `path`, as paths of the file system that `_open` returns."""
    from pyarrow import fs

    system, root = _open(path)
    if system.get_file_info(root).type == fs.FileType.File:
        return [root]
    found = system.get_file_info(fs.FileSelector(root))
    return sorted(
        f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".feather")
    )


class _Split(InputPartition):
    def __init__(self, file: str, first: int, stop: int):
        self.file, self.first, self.stop = file, first, stop


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self):
        import pyarrow as pa

        system, _ = _open(self.path)
        splits = []
        for file in _files(self.path):
            with system.open_input_file(file) as handle:
                n = pa.ipc.open_file(handle).num_record_batches
            splits += [
                _Split(file, i, min(i + BATCHES_PER_SPLIT, n)) for i in range(0, n, BATCHES_PER_SPLIT)
            ]
        return splits or [_Split("", 0, 0)]

    def read(self, partition):
        import pyarrow as pa

        if not partition.file:
            return
        system, _ = _open(self.path)
        with system.open_input_file(partition.file) as handle:
            reader = pa.ipc.open_file(handle)
            for i in range(partition.first, partition.stop):
                batch = reader.get_batch(i).select(self.columns)
                plain = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in batch.columns]
                yield pa.RecordBatch.from_arrays(plain, names=self.columns)


class _Written(WriterCommitMessage):
    def __init__(self, temporary: str, final: str):
        self.temporary, self.final = temporary, final


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, columns: list[str]):
        from uuid import uuid4

        self.path, self.overwrite, self.columns, self.job = path, overwrite, columns, uuid4().hex

    def write(self, iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        system, root = _open(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05}-{self.job}"
        temporary = f"{root}/_temporary-{self.job}/{name}-{task.taskAttemptId()}"
        system.create_dir(f"{root}/_temporary-{self.job}", recursive=True)
        sink = writer = None
        try:
            for batch in iterator:
                if writer is None:
                    sink = system.open_output_stream(temporary)
                    writer = pa.ipc.new_file(sink, batch.schema)
                writer.write_batch(batch)
        finally:
            if writer is not None:
                writer.close()
                sink.close()
        return _Written(temporary if writer is not None else "", f"{root}/{name}.feather")

    def commit(self, messages):
        system, root = _open(self.path)
        if self.overwrite:
            for file in _files(self.path):
                system.delete_file(file)
        for message in messages:
            if message is not None and message.temporary:
                system.move(message.temporary, message.final)
        system.delete_dir(f"{root}/_temporary-{self.job}")

    def abort(self, messages):
        from pyarrow import fs

        system, root = _open(self.path)
        if system.get_file_info(f"{root}/_temporary-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_temporary-{self.job}")


class FeatherSource(DataSource):
    @classmethod
    def name(cls):
        return "feather"

    def schema(self):
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        system, _ = _open(self.options["path"])
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no feather files at {self.options['path']}")
        with system.open_input_file(files[0]) as handle:
            found = pa.ipc.open_file(handle).schema
        plain = [
            pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in found
        ]
        return from_arrow_schema(pa.schema(plain))

    def reader(self, schema):
        return _Reader(self.options["path"], schema.fieldNames())

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite, schema.fieldNames())


def _hadoop(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path with its scheme."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system, found.makeQualified(system.getUri(), system.getWorkingDirectory())


def _plain_schema(content: bytes):
    """The schema of a file, with dictionaries as their values."""
    import pyarrow as pa

    found = pa.ipc.open_file(pa.BufferReader(content)).schema
    return pa.schema([pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in found])


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """The Feather files at `path`, a file or a folder, in parallel; files whose schema differs from the others' are refused."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    bounded_batches(spark)
    system, root = _hadoop(spark, path)
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", "*.feather") if system.getFileStatus(root).isDirectory() else reader).load(root.toString())
    smallest = files.select("path", "length").orderBy("length", "path").first()
    if smallest is None:
        raise ValueError(f"no feather files at {path}")

    def schemas(batches: Iterator) -> Iterator:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_plain_schema(c).serialize().to_pybytes() for c in batch.column(0).to_pylist()], pa.binary())], ["schema"])

    first = files.where(F.col("path") == smallest.path).select("content").mapInArrow(schemas, "schema binary").first()
    wanted = pa.ipc.read_schema(pa.BufferReader(bytes(first.schema)))

    def rows(batches: Iterator) -> Iterator:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = content.as_buffer()
                if not _plain_schema(content).equals(wanted):
                    raise ValueError(f"{name} has other columns than {smallest.path}")
                reader = pa.ipc.open_file(pa.BufferReader(content))
                for k in range(reader.num_record_batches):
                    own = reader.get_batch(k)
                    plain = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in own.columns]
                    yield pa.RecordBatch.from_arrays(plain, names=wanted.names)

    return files.select("path", "content").mapInArrow(rows, from_arrow_schema(wanted))


def write_feather(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write `df` as Feather files; `mode` is errorifexists, append or overwrite."""
    import pyarrow as pa

    spark = df.sparkSession
    bounded_batches(spark)
    system, root = _hadoop(spark, path)
    if mode == "errorifexists" and system.exists(root):
        raise ValueError(f"{path} exists")
    job = uuid4().hex
    uri = root.toString()
    uri = "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri
    temporary, limit = f"{uri}/_temporary-{job}", FILE_BYTES

    def write(batches: Iterator) -> Iterator:
        from pyarrow import fs
        from pyspark import TaskContext

        files, folder = fs.FileSystem.from_uri(temporary)
        task, made, size, sink, writer = TaskContext.get(), [], 0, None, None
        for batch in batches:
            if writer is None:
                made.append(f"part-{task.partitionId():05}-{len(made):04}-{task.taskAttemptId()}.feather")
                sink = files.open_output_stream(f"{folder}/{made[-1]}")
                writer, size = pa.ipc.new_file(sink, batch.schema), 0
            writer.write_batch(batch)
            size += batch.nbytes
            if size >= limit:
                writer.close()
                sink.close()
                writer = None
        if writer is not None:
            writer.close()
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["name"])

    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = path_of(f"{root.toString()}/_temporary-{job}")
    system.mkdirs(folder)
    try:
        # one name per file that a successful attempt has finished
        made = [r.name for r in df.mapInArrow(write, "name string").collect()]
        system.mkdirs(root)
        if mode == "overwrite":
            for status in system.listStatus(root):
                if status.isFile() and status.getPath().getName().endswith(".feather"):
                    system.delete(status.getPath(), False)
        for name in made:
            final = path_of(f"{root.toString()}/{name.removesuffix('.feather')}-{job}.feather")
            if not system.rename(path_of(folder, name), final):
                raise OSError(f"{name} could not be renamed")
    finally:
        # tasks of a failed job may still write, but no longer once the folder is gone
        for _ in range(5):
            system.delete(folder, True)
            if not system.exists(folder):
                break


# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def register_feather(spark: SparkSession) -> None:
    spark.dataSource.register(FeatherSource)
