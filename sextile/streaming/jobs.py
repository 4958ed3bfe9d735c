"""Scoring and daily figures as Structured Streaming queries.

Each job takes a streaming frame and starts a query that is restarted from its checkpoint. With
`available_now` it works off what is there and ends; otherwise it goes on, with one micro-batch
`every` so often ("5 minutes"), and longer pauses make fewer and larger files.
"""

from __future__ import annotations

import hashlib

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..functions.constants import TEXT_COLUMN
from ..functions.times import instant, utc_date
from ..operators.registry import with_active
from ..plans import rollup
from ..plans.scoring import scored_log_rows
from ..sources.bundle import load_model
from ..sources.shared import children, file_system
from ..sources.store import append_predictions, read_registry, stream_folder


def read_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    files_per_trigger: int | None = None,
    bytes_per_trigger: str | None = None,
) -> DataFrame:
    """A stream of parquet files; `path` may be a folder or a glob.

    A backlog is worked off in micro-batches of so many files or bytes ("10g"), each of them
    committed; without a bound it is one.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.parquet(path)


def stream_scores(
    model: PipelineModel,
    stream: DataFrame,
    log_path: str,
    checkpoint: str,
    id_col: str,
    text_col: str = TEXT_COLUMN,
    version: str | None = None,
    timestamp_col: str | None = None,
    available_now: bool = False,
    every: str | None = None,
) -> StreamingQuery:
    """Score every text that arrives and append it to the log, each row exactly once.

    The stream has a folder of its own in the log, named after its checkpoint, so that streams and
    batches do not hide each other's rows; `read_log` reads them all.
    """
    rows = scored_log_rows(model, stream, id_col, text_col, version, timestamp_col)
    writer = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("date")
        .option("path", stream_folder(log_path, checkpoint))
        .option("checkpointLocation", checkpoint)
    )
    return _start(writer, available_now, every)


def stream_active_scores(
    stream: DataFrame,
    models: str,
    registry: str,
    log_path: str,
    checkpoint: str,
    id_col: str,
    text_col: str = TEXT_COLUMN,
    timestamp_col: str | None = None,
    available_now: bool = False,
    every: str | None = None,
) -> StreamingQuery:
    """Score with the model that is active when a micro-batch begins, and append to the log.

    The active one is the last of the registry; its name there is that of its bundle in `models`, and
    the log's version names it with its id. A new one is loaded between micro-batches, without a
    restart. A micro-batch is a named batch of the log, so one that is repeated after a restart replaces itself.
    """
    loaded: dict[int, PipelineModel] = {}

    def write_scores(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        active = with_active(read_registry(spark, registry)).where("is_active").first()
        if active is None:
            raise ValueError(f"there is no model in {registry}")
        if active["id"] not in loaded:
            loaded.clear()
            loaded[active["id"]] = load_model(spark, models, active["model_name"])[0]
        version = f"{active['model_name']} {active['id']}"
        scored = scored_log_rows(loaded[active["id"]], rows, id_col, text_col, version, timestamp_col)
        append_predictions(
            scored, log_path, timestamp_col is not None, f"{checkpoint.rstrip('/')} {batch_id}"
        )

    writer = stream.writeStream.foreachBatch(write_scores).option("checkpointLocation", checkpoint)
    return _start(writer, available_now, every)


def stream_rollup(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    available_now: bool = False,
    every: str | None = None,
    merge_every: int = 100,
) -> StreamingQuery:
    """Feed a streamed log to the live store of daily figures, each micro-batch once.

    `plans.rollup.read_live` gives the figures of all batches and streams that feed the store.
    """

    def write_state(rows: DataFrame, batch_id: int) -> None:
        rollup.add_batch(rows.withColumn("timestamp", instant(rows, "timestamp")), path, checkpoint, batch_id)
        if batch_id and batch_id % merge_every == 0:
            rollup.merge_batches(rows.sparkSession, path)

    writer = stream.writeStream.foreachBatch(write_state).option("checkpointLocation", checkpoint)
    return _start(writer, available_now, every)


def daily_figures(stream: DataFrame, delay: str | None = None) -> DataFrame:
    """Count and mean confidence by category and UTC day of a streamed log.

    The state is one row per category and day, and every late row counts. With `delay`, days older
    than the watermark leave the state, and rows that come later than that are dropped.
    """
    timed = stream.withColumn("timestamp", instant(stream, "timestamp"))
    if delay:
        timed = timed.withWatermark("timestamp", delay)
    return (
        timed.groupBy(F.window("timestamp", "1 day").alias("day"), "predicted_category")
        .agg(F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("avg_confidence"))
        .select(F.col("day.start").alias("start"), "predicted_category", "count", "avg_confidence")
        .withColumn("date", utc_date("start"))
        .drop("start")
    )


def stream_daily_stats(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    delay: str | None = None,
    available_now: bool = False,
    every: str | None = None,
    compact_every: int = 100,
) -> StreamingQuery:
    """Keep the daily figures of a streamed log up to date.

    Every micro-batch writes only the figures that changed, under its own number, so that a
    repeated batch replaces itself; one in `compact_every` writes them all, and what is older than
    the one before goes. `read_daily_stats` gives the current state. The folder belongs to one
    checkpoint, as another one's batches would count from 0 again.
    """
    _own(stream.sparkSession, path, checkpoint)

    def write_changes(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        whole = batch_id > 0 and batch_id % compact_every == 0
        if whole:
            earlier = _written_figures(spark, path).where(F.col("batch_id") < batch_id)
            now = changed.withColumn("batch_id", F.lit(batch_id).cast("long"))
            changed = _latest(earlier.unionByName(now)).coalesce(1)
        changed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if whole:
            for name in children(spark, path):
                # The whole figures before these were committed long ago and cover what goes.
                if name.startswith("batch_id=") and int(name[9:]) < batch_id - compact_every:
                    folder, files = file_system(spark, f"{path}/{name}")
                    files.delete(folder, True)

    figures = daily_figures(stream, delay)
    writer = (
        figures.writeStream.outputMode("update")
        .foreachBatch(write_changes)
        .option("checkpointLocation", checkpoint)
    )
    return _start(writer, available_now, every)


def read_daily_stats(spark: SparkSession, path: str) -> DataFrame:
    """The last written figure of every category and day; none before the first."""
    return _latest(_written_figures(spark, path))


def _written_figures(spark: SparkSession, path: str) -> DataFrame:
    schema = "predicted_category string, count long, avg_confidence double, date date, batch_id long"
    if not any(name.startswith("batch_id=") for name in children(spark, path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _latest(figures: DataFrame) -> DataFrame:
    latest = F.max_by(F.struct("count", "avg_confidence"), "batch_id").alias("_last")
    return (
        figures.groupBy("predicted_category", "date")
        .agg(latest)
        .select("predicted_category", "_last.count", "_last.avg_confidence", "date")
    )


def _own(spark: SparkSession, path: str, checkpoint: str) -> None:
    """Claim a folder of figures for a checkpoint, or fail if it is another's."""
    name = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()
    owners = children(spark, f"{path}/_owner")
    if owners and name not in owners:
        raise ValueError(f"{path} holds the figures of another checkpoint than {checkpoint}")
    folder, files = file_system(spark, f"{path}/_owner/{name}")
    files.mkdirs(folder)


def _start(writer: DataStreamWriter, available_now: bool, every: str | None) -> StreamingQuery:
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()
