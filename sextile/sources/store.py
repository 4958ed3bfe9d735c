"""The prediction log and the model registry: append-only parquet tables."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from datetime import date, datetime, timezone
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import log_text
from ..functions.times import instant, utc_date
from .shared import children, delete, file_system, read_text, write_text

LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("predicted_category", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("date", T.DateType()),
    ]
)

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("f1_score", T.DoubleType()),
        T.StructField("precision_score", T.DoubleType()),
        T.StructField("recall_score", T.DoubleType()),
        T.StructField("trained_date", T.TimestampType()),
        T.StructField("training_time", T.DoubleType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("n_train", T.LongType()),
        T.StructField("n_test", T.LongType()),
        T.StructField("framework", T.StringType()),
        T.StructField("inserted_at", T.TimestampType()),
    ]
)


def create_tables(spark: SparkSession, root: str) -> tuple[str, str]:
    """Make both tables if they are missing; returns their paths."""
    log_path, registry_path = f"{root}/predictions", f"{root}/model_metadata"
    empty_log = spark.createDataFrame([], LOG_SCHEMA)
    empty_log.write.mode("ignore").partitionBy("date").parquet(log_path)
    spark.createDataFrame([], REGISTRY_SCHEMA).write.mode("ignore").parquet(registry_path)
    return log_path, registry_path


def log_rows(
    scored: DataFrame,
    id_col: str,
    text_col: str = "text",
    version: str | None = None,
    timestamp_col: str | None = None,
) -> DataFrame:
    """Rows in the shape of the log: text cut for storage, version defaulted, UTC day.

    The key is the caller's, since a running number would need one task. Without `timestamp_col`
    a row carries the time of the query; a time without a zone is one in UTC. A row without text or category fails the job, as both
    columns of the log are required.
    """
    stamp = instant(scored, timestamp_col) if timestamp_col else F.current_timestamp()
    return scored.select(
        F.col(id_col).cast("long").alias("id"),
        _required(log_text(text_col), "text").alias("text"),
        _required(F.col("predicted_category"), "category").alias("predicted_category"),
        F.col("confidence").cast("double").alias("confidence"),
        stamp.alias("timestamp"),
        F.coalesce(F.lit(version).cast("string"), F.lit("Unknown")).alias("model_version"),
    ).withColumn("date", utc_date("timestamp"))


# Readers of a log's own folder pass over names like these.
STREAMS, BATCHES, COMMITS = "_streams", "_batches", "_commits"
COMPACTED, MANIFEST = "_compacted", "_manifest"


def append_predictions(
    rows: DataFrame, path: str, many_days: bool = False, batch: str | None = None
) -> None:
    """Append one batch of `log_rows`.

    A batch of today's predictions is one partition and is written in place, without a shuffle.
    A backfill over `many_days` is rebalanced on the day first, so that files are of even size:
    small days are merged and a day with most of the rows is split over tasks.

    A call that may be repeated gives its `batch` a name. Rows of a name are in the log once: the call
    writes a folder of its own, which a commit record then makes part of the log in one step, in place
    of what an earlier call under the name wrote. An interrupted call leaves nothing that is read.
    """
    if many_days:
        rows = rows.hint("rebalance", "date")
    if batch is None:
        rows.write.mode("append").partitionBy("date").parquet(path)
        return
    spark = rows.sparkSession
    key = _key(batch)
    if key in _manifest(spark, path)["batches"]:
        # Merged with others by now, which is done for committed batches only.
        return
    attempt = uuid.uuid4().hex
    rows.write.partitionBy("date").parquet(f"{path}/{BATCHES}/{key}/{attempt}")
    if key in _manifest(spark, path)["batches"]:
        delete(spark, f"{path}/{BATCHES}/{key}/{attempt}")
        return
    write_text(spark, f"{path}/{COMMITS}/{key}", attempt, overwrite=True)
    for name in children(spark, f"{path}/{BATCHES}/{key}"):
        if name != attempt:
            delete(spark, f"{path}/{BATCHES}/{key}/{name}")


def _key(name: str) -> str:
    return hashlib.md5(name.encode()).hexdigest()


def stream_folder(path: str, checkpoint: str) -> str:
    """Where the stream with this checkpoint writes within the log at `path`.

    A stream's sink keeps a list of its own files, which readers of its folder go by alone.
    """
    return f"{path}/{STREAMS}/{_key(checkpoint.rstrip('/'))}"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all writers: batches in the log's own folder, named ones, and each stream.

    Files that a compaction has merged are passed over, and its own are read instead.
    """
    manifest = _manifest(spark, path)
    reader = spark.read.schema(LOG_SCHEMA)
    merged = set(manifest["files"])
    parts = []
    for folder in _folders(spark, path, manifest):
        if not merged:
            parts.append(reader.parquet(folder))
        elif files := _live(spark, folder, merged):
            parts.append(reader.option("basePath", folder).parquet(*files))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], LOG_SCHEMA)


def compact_log(
    spark: SparkSession, path: str, below: int = 64 << 20, always: bool = False
) -> int:
    """Merge the files of the log that are smaller than `below` bytes; returns how many they were.

    The merged rows are written first; then a manifest with the names of the files they replace comes
    into force in one step. Readers see every row once at any time, and writers and running streams
    go on undisturbed. Of two compactions at once, the second fails and changes nothing. The replaced files stay
    for readers that have started, until `expire_replaced`.

    With `always`, no file is merged for its size, but those of streams are, and those whose day and
    folder have replaced files too, so that all that is live stands in folders of live files alone.
    """
    manifest = _manifest(spark, path)
    merged = set(manifest["files"])
    folders = _folders(spark, path, manifest)
    if always:
        small = {f: _beside_replaced(spark, path, f, merged) for f in folders}
    else:
        small = {f: [x for x in _live(spark, f, merged) if _size(spark, x) < below] for f in folders}
    count = sum(map(len, small.values()))
    if count < (1 if always else 2):
        return 0
    reader = spark.read.schema(LOG_SCHEMA)
    rows = reduce(
        DataFrame.union,
        [reader.option("basePath", f).parquet(*files) for f, files in small.items() if files],
    )
    name = uuid.uuid4().hex
    rows.hint("rebalance", "date").write.partitionBy("date").parquet(f"{path}/{COMPACTED}/{name}")
    # A batch is closed once any of its files is merged: it can no longer be written again.
    closed = dict(f.split("/")[-2:] for f, files in small.items() if files and f"/{BATCHES}/" in f)
    new = {
        "version": manifest["version"] + 1,
        "folders": [*manifest["folders"], name],
        "files": sorted(merged | {_file_key(x) for files in small.values() for x in files}),
        "batches": manifest["batches"] | closed,
    }
    write_text(spark, f"{path}/{MANIFEST}/{new['version']:08d}", json.dumps(new))
    return count


def _beside_replaced(spark: SparkSession, path: str, folder: str, merged: set[str]) -> list[str]:
    """Live files of a stream, or of a day of which other files in the folder are replaced."""
    live = _live(spark, folder, merged)
    if folder.startswith(f"{path}/{STREAMS}/"):
        return live
    replaced = {_day(x) for x in _files(spark, folder) if _file_key(x) in merged}
    return [x for x in live if _day(x) in replaced]


def _day(file: str) -> str:
    return unquote(file).split("/")[-2]


def live_partitions(spark: SparkSession, path: str) -> list[tuple[str, date, str]]:
    """(folder's name, day, path) of all days of all folders that have live files.

    Right after `compact_log` with `always`; days that have replaced files beside live ones, which come
    with later compactions, are an error.
    """
    manifest = _manifest(spark, path)
    merged = set(manifest["files"])
    found: dict[tuple[str, str], str] = {}
    for folder in _folders(spark, path, manifest):
        if folder.startswith(f"{path}/{STREAMS}/"):
            continue
        if _beside_replaced(spark, path, folder, merged):
            raise RuntimeError("the log was compacted meanwhile")
        part = folder[len(path) :].strip("/").replace("/", ".") or "own"
        for file in _live(spark, folder, merged):
            found[part, _day(file)] = unquote(file).rsplit("/", 1)[0]
    return [
        (part, date.fromisoformat(day.removeprefix("date=")), where)
        for (part, day), where in found.items()
        if day.removeprefix("date=")[:1].isdigit()
    ]


def expire_replaced(spark: SparkSession, path: str) -> None:
    """Delete the files that compactions have replaced, once no reader from before is left."""
    manifest = _manifest(spark, path)
    merged = set(manifest["files"])
    for folder in _folders(spark, path, manifest):
        for file in _files(spark, folder):
            if _file_key(file) in merged:
                delete(spark, unquote(file))


def _manifest(spark: SparkSession, path: str) -> dict:
    """The one of the last compaction: its folders, files they replace, and attempts of closed batches."""
    versions = [name for name in children(spark, f"{path}/{MANIFEST}") if name.isdigit()]
    if not versions:
        return {"version": 0, "folders": [], "files": [], "batches": {}}
    return json.loads(read_text(spark, f"{path}/{MANIFEST}/{max(versions)}"))


def _files(spark: SparkSession, folder: str) -> list[str]:
    return spark.read.schema(LOG_SCHEMA).parquet(folder).inputFiles()


def _live(spark: SparkSession, folder: str, merged: set[str]) -> list[str]:
    return [unquote(f) for f in _files(spark, folder) if _file_key(f) not in merged]


def _file_key(file: str) -> str:
    """A file by its partition and name, which has the number of its job in it."""
    return "/".join(unquote(file).split("/")[-2:])


def _size(spark: SparkSession, file: str) -> int:
    where, files = file_system(spark, file)
    return files.getFileStatus(where).getLen()


def log_days(spark: SparkSession, path: str) -> list[date]:
    """The days that the log has partitions of, newest first, from the names of folders alone."""
    folders = _folders(spark, path, _manifest(spark, path))
    names = {name for folder in folders for name in children(spark, folder)}
    days = {name.removeprefix("date=") for name in names if name.startswith("date=")}
    return sorted((date.fromisoformat(d) for d in days if d[:1].isdigit()), reverse=True)


def read_recent_log(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The newest days of the log that together hold `n` rows; files of older days stay closed."""
    log, days, taken = read_log(spark, path), log_days(spark, path), 1
    while taken < len(days):
        recent = log.where(F.col("date") >= F.lit(days[taken - 1]))
        if recent.limit(n).count() >= n:
            return recent
        taken *= 2
    return log


def _folders(spark: SparkSession, path: str, manifest: dict) -> list[str]:
    streams = sorted(children(spark, f"{path}/{STREAMS}"))
    committed = [
        f"{BATCHES}/{key}/{read_text(spark, f'{path}/{COMMITS}/{key}')}"
        for key in sorted(children(spark, f"{path}/{COMMITS}"))
        if not key.startswith(".") and key not in manifest["batches"]
    ]
    closed = [f"{BATCHES}/{key}/{attempt}" for key, attempt in manifest["batches"].items()]
    compacted = [f"{COMPACTED}/{name}" for name in manifest["folders"]]
    parts = [*(f"{STREAMS}/{name}" for name in streams), *committed, *closed, *compacted]
    return [path, *(f"{path}/{name}" for name in parts)]


def append_model(spark: SparkSession, path: str, metadata: dict) -> int:
    """Append one run to the registry and return its id; earlier rows are never rewritten."""
    model_id = time.time_ns() // 1000
    trained = datetime.fromisoformat(metadata["trained_date"])
    row = {
        "id": model_id,
        "model_name": metadata["model_type"],
        "accuracy": metadata["accuracy"],
        "f1_score": metadata["f1_score"],
        "precision_score": metadata["precision"],
        "recall_score": metadata["recall"],
        "trained_date": trained,
        "training_time": metadata["training_time"],
        "n_samples": metadata["n_samples"],
        "n_train": metadata["n_train"],
        "n_test": metadata["n_test"],
        "framework": metadata["framework"],
        "inserted_at": datetime.now(timezone.utc),
    }
    one = spark.createDataFrame([tuple(row[f.name] for f in REGISTRY_SCHEMA)], REGISTRY_SCHEMA)
    one.coalesce(1).write.mode("append").parquet(path)
    return model_id


def append_runs(runs: DataFrame, path: str) -> None:
    """Append a frame of runs; columns of the registry that it lacks become null."""
    runs.select(
        *[
            (F.col(f.name) if f.name in runs.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in REGISTRY_SCHEMA
        ]
    ).write.mode("append").parquet(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(path)


def _required(column: Column, name: str) -> Column:
    # Not a filter: that would be pushed below the model and run it twice.
    return F.coalesce(column, F.raise_error(F.lit(f"a log row has no {name}")))
