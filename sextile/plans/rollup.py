"""The daily figures of the prediction log as a stored table, from which all reports can be made."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import utc_day
from ..operators.analytics import daily_rollup, daily_state, merged_state
from ..sources.shared import children, delete, read_text, write_text

_SCHEMA = (
    "predicted_category string, count long, avg_confidence double, confidence_sum double,"
    " confidence_count long, last_timestamp timestamp, date date"
)


def update_rollup(log: DataFrame, path: str, days: Iterable[date] | None = None) -> None:
    """Bring the stored figures up to date, for all days or for the UTC days that have new rows.

    Only these days of a stored log are read, and only their partitions of the table are replaced,
    so a repeated or interrupted call does no harm. The log only grows: no day ever becomes empty.
    """
    if days is not None:
        days = sorted(set(days))
        if not days:
            return
        log = log.where(utc_day(log).isin(days))
    (
        daily_rollup(log)
        .hint("rebalance", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path)


_STATE = (
    "predicted_category string, date date, count long, confidence_sum double, confidence_count long,"
    " last_timestamp timestamp, bins array<long>, texts binary"
)


def add_batch(rows: DataFrame, path: str, source: str, number: int) -> None:
    """Add the figures of one batch of log rows to the live store at `path`.

    A source, such as a stream's checkpoint, numbers its batches from 0 on. The batch has a folder of
    its own, so a repeated call replaces what it wrote, and once `merge_batches` has taken it in, a
    repeated call does nothing. No more than a row for each category and day is written.
    """
    spark = rows.sparkSession
    key = hashlib.md5(source.rstrip("/").encode()).hexdigest()
    if number <= _merged(spark, path)["done"].get(key, -1):
        return
    stamped = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    daily_state(stamped).coalesce(1).write.mode("overwrite").parquet(_part(path, key, number))


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """The state of every category and day over all batches added so far (`analytics.rollup_of`)."""
    manifest = _merged(spark, path)
    folders = [f"{path}/merged/{name}" for name in [manifest["folder"]] if name]
    folders += [_part(path, key, n) for key, n in _waiting(spark, path, manifest)]
    if not folders:
        return spark.createDataFrame([], _STATE)
    return merged_state(spark.read.schema(_STATE).parquet(*folders))


def merge_batches(spark: SparkSession, path: str) -> int:
    """Merge all batches added so far into one table; returns how many they were.

    A manifest brings the table into force in one step, for readers as for repeated batches. For one caller at
    a time; batches may be added meanwhile. Batches of a source must have been added in their order.
    """
    manifest = _merged(spark, path)
    waiting = _waiting(spark, path, manifest)
    if not waiting:
        return 0
    name = uuid.uuid4().hex
    folders = [f"{path}/merged/{old}" for old in [manifest["folder"]] if old]
    folders += [_part(path, key, n) for key, n in waiting]
    whole = merged_state(spark.read.schema(_STATE).parquet(*folders))
    whole.write.parquet(f"{path}/merged/{name}")
    done = dict(manifest["done"])
    for key, n in waiting:
        done[key] = max(n, done.get(key, -1))
    new = {"version": manifest["version"] + 1, "folder": name, "done": done}
    write_text(spark, f"{path}/_manifest/{new['version']:08d}", json.dumps(new))
    for key, n in waiting:
        delete(spark, _part(path, key, n))
    return len(waiting)


def _part(path: str, key: str, number: int) -> str:
    return f"{path}/batches/{key}-{number}"


def _merged(spark: SparkSession, path: str) -> dict:
    versions = [name for name in children(spark, f"{path}/_manifest") if name.isdigit()]
    if not versions:
        return {"version": 0, "folder": None, "done": {}}
    return json.loads(read_text(spark, f"{path}/_manifest/{max(versions)}"))


def _waiting(spark: SparkSession, path: str, manifest: dict) -> list[tuple[str, int]]:
    """Batches that were written whole and are not merged yet."""
    out = []
    for name in sorted(children(spark, f"{path}/batches")):
        key, number = name.rsplit("-", 1)
        if int(number) > manifest["done"].get(key, -1):
            if "_SUCCESS" in children(spark, f"{path}/batches/{name}"):
                out.append((key, int(number)))
    return out
