"""Tables in the folder that all executors share, to cut lineage and to reuse costly steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A side of a join is broadcast only if it was counted and is no longer than this.
BROADCAST_ROWS = 200_000
# The same for the bytes of its strings.
BROADCAST_BYTES = 64 << 20


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; only a local session may go without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="sextile-")
        context.setCheckpointDir(_local_dirs[context.applicationId])
    return _local_dirs[context.applicationId]


def file_system(spark: SparkSession, path: str):
    """A path as Hadoop knows it, and the file system it is on."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    folder, files = file_system(spark, path)
    return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []


def stored_bytes(spark: SparkSession, path: str) -> int:
    """The bytes of a file, a folder or all that a glob matches."""
    where, files = file_system(spark, path)
    return sum(files.getContentSummary(s.getPath()).getLength() for s in files.globStatus(where) or ())


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """A small file that readers see whole or not at all.

    Without `overwrite` the call fails if there is such a file, even if another writer makes it at the
    same moment.
    """
    jvm, target = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = target.getFileSystem(conf).create(draft)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    how = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE if overwrite else how.NONE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        target.getFileSystem(conf).getUri(), conf
    )
    files.rename(draft, target, options)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file, None if there is none."""
    file, files = file_system(spark, path)
    if not files.exists(file):
        return None
    stream = files.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    file, files = file_system(spark, path)
    files.delete(file, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back.

    Unlike a cached frame the table survives the loss of executors, and unlike an RDD checkpoint
    it keeps column pruning, filter pushdown and size statistics. It stays until the folder is
    cleared, as the frames read from it are lazy; `Scratch` is for jobs that end.
    """
    return _written(df, new_path(df.sparkSession, name))


class Scratch:
    """Tables that are dropped when the job that wrote them is over."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def path(self, name: str) -> str:
        """A new path that is deleted with the tables."""
        self._paths.append(new_path(self._spark, name))
        return self._paths[-1]

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, self.path(name))

    def __exit__(self, *error) -> None:
        for path in self._paths:
            delete(self._spark, path)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Deal the rows of a source with fewer splits than cores out to all of them.

    Meant for a frame that only reads and projects a source: one small file, a file of one row
    group or a multi-line CSV is one task otherwise. Fewer splits than cores also means that a
    core gets no more than a split by the shuffle. A source with enough splits, which is the rule
    at scale, is returned as it is. `key` must be unique, so that no task gets a hot share.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *key)
