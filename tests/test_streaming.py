"""Streams against batches over the same rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sextile.operators import analytics
from sextile.plans import queries, scoring, views
from sextile.sources import shared, store
from sextile.streaming import jobs

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_scores_equal_batch_after_a_restart(spark, folder):
    model = queries.small_model(spark, SF).model
    documents = views.table(spark, SF, "documents").select("doc_id", "text")
    blank = spark.createDataFrame([(10**6, " \t"), (10**6 + 1, None)], documents.schema)
    for part in range(3):
        documents.where(F.col("doc_id") % 3 == part).coalesce(1).write.parquet(
            f"{folder}/in", mode="append"
        )

    def run():
        stream = jobs.read_stream(spark, f"{folder}/in", documents.schema, files_per_trigger=1)
        query = jobs.stream_scores(
            model, stream, f"{folder}/log", f"{folder}/cp", "doc_id", version="v1",
            available_now=True,
        )
        query.awaitTermination()
        return query

    assert len(run().recentProgress) >= 3
    blank.coalesce(1).write.parquet(f"{folder}/in", mode="append")
    run()  # goes on from the checkpoint: nothing is scored twice, blanks are dropped
    log = store.read_log(spark, f"{folder}/log")
    batch = scoring.scored_log_rows(model, documents, "doc_id", version="v1")
    columns = ["id", "text", "predicted_category", "confidence", "model_version"]
    assert rows_of(log.select(*columns)) == rows_of(batch.select(*columns))


def log_files(spark, folder, batches):
    schema = "id long, predicted_category string, confidence double, timestamp timestamp"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder, mode="append")
    return spark.read.parquet(folder).schema


def test_daily_figures_over_many_batches(spark, folder):
    log = views.prediction_log(spark, SF).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    for part in range(4):
        log.where(F.col("id") % 4 == part).coalesce(1).write.parquet(f"{folder}/in", mode="append")

    def run():
        stream = jobs.read_stream(spark, f"{folder}/in", log.schema, files_per_trigger=1)
        query = jobs.stream_daily_stats(
            stream, f"{folder}/out", f"{folder}/cp", delay="60 days", available_now=True
        )
        query.awaitTermination()

    def compare(batch):
        stats = analytics.prediction_stats(analytics.daily_rollup(batch))
        got = jobs.read_daily_stats(spark, f"{folder}/out")
        assert got.columns == ["predicted_category", "count", "avg_confidence", "date"]
        assert rows_of(views.rounded(got, ["avg_confidence"])) == rows_of(
            views.rounded(stats, ["avg_confidence"])
        )

    run()
    compare(log)
    log.where("id < 200").coalesce(1).write.parquet(f"{folder}/in", mode="append")
    run()  # state is restored from the checkpoint and the day's figures go on
    compare(log.unionAll(log.where("id < 200")))


def test_late_rows(spark, folder):
    start = datetime(2024, 3, 1, 12)
    day = timedelta(days=1)
    batches = [
        [(1, "Legal", 0.5, start)],
        [(2, "Legal", 0.7, start + 2 * day)],
        # Within the delay: counted.
        [(3, "Legal", 0.9, start), (4, "Legal", 0.1, start + 10 * day)],
        # The watermark has passed that day by now: dropped.
        [(5, "Legal", 0.3, start)],
    ]
    written = f"{folder}/in"
    schema = None
    for batch in batches:
        schema = log_files(spark, written, [batch])
        stream = jobs.read_stream(spark, written, schema, files_per_trigger=1)
        jobs.stream_daily_stats(
            stream, f"{folder}/out", f"{folder}/cp", delay="3 days", available_now=True
        ).awaitTermination()
    got = {str(r.date): (r["count"], round(r.avg_confidence, 6)) for r in
           jobs.read_daily_stats(spark, f"{folder}/out").collect()}
    assert got == {"2024-03-01": (2, 0.7), "2024-03-03": (1, 0.7), "2024-03-11": (1, 0.1)}


def test_streams_of_ntz_timestamps(spark):
    """The given events carry a zoneless time, which a watermark refuses; it is cast first."""
    figures = jobs.daily_figures(queries._source_stream(spark, SF, "events").select(
        F.lit("Legal").alias("predicted_category"),
        F.lit(0.5).alias("confidence"),
        F.col("ts").alias("timestamp"),
    ))
    assert figures.isStreaming
    assert figures.columns == ["predicted_category", "count", "avg_confidence", "date"]


@pytest.mark.parametrize("name", ["documents", "events"])
def test_source_is_one_file_or_a_folder(spark, folder, name):
    table = views.table(spark, SF, name)
    table.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    for root in (SF, folder):
        query = (
            queries._source_stream(spark, root, name)
            .writeStream.format("noop")
            .trigger(availableNow=True)
            .option("checkpointLocation", f"{folder}/cp-{root.count('/')}-{name}-{len(root)}")
            .start()
        )
        query.awaitTermination()
        assert sum(p["numInputRows"] for p in query.recentProgress) == table.count()


def test_writers_of_one_log_do_not_hide_each_other(spark, folder):
    """Batches and streams in turn, each stream with its own checkpoint and restarted once."""
    log = f"{folder}/log"

    def rows(first, n):
        ids = spark.range(first, first + n).withColumn("text", F.concat(F.lit("t"), "id"))
        return ids.selectExpr(
            "id", "text", "'Legal' predicted_category", "0.5D confidence",
            "timestamp'2024-01-02 03:04:05' timestamp", "'v' model_version", "date'2024-01-02' date",
        )

    def stream(name, source):
        frame = spark.readStream.schema(rows(0, 1).schema).parquet(source)
        query = (
            frame.writeStream.format("parquet").partitionBy("date")
            .option("path", store.stream_folder(log, f"{folder}/{name}"))
            .option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
        )
        assert query.awaitTermination(60)

    store.append_predictions(rows(0, 3), log)
    for name, first in (("a", 10), ("b", 20), ("a", 30)):
        rows(first, 4).write.mode("append").parquet(f"{folder}/source_{name}")
        stream(name, f"{folder}/source_{name}")
    store.append_predictions(rows(40, 2), log)
    got = sorted(r.id for r in store.read_log(spark, log).collect())
    assert got == [0, 1, 2, *range(10, 14), *range(20, 24), *range(30, 34), 40, 41]


def test_figures_are_compacted_and_belong_to_one_checkpoint(spark, folder):
    day = datetime(2024, 3, 1)
    schema = None
    for i in range(7):
        rows = [(i, "Legal", 0.5, day + timedelta(days=i)), (100 + i, "Social", 0.1, day)]
        schema = log_files(spark, f"{folder}/in", [rows])
    stream = jobs.read_stream(spark, f"{folder}/in", schema, files_per_trigger=1)
    assert jobs.read_daily_stats(spark, f"{folder}/out").count() == 0
    jobs.stream_daily_stats(
        stream, f"{folder}/out", f"{folder}/cp", available_now=True, compact_every=2
    ).awaitTermination()
    got = {(r.predicted_category, str(r.date)): r["count"] for r in
           jobs.read_daily_stats(spark, f"{folder}/out").collect()}
    want = {("Legal", f"2024-03-0{i + 1}"): 1 for i in range(7)} | {("Social", "2024-03-01"): 7}
    assert got == want
    kept = sorted(n for n in shared.children(spark, f"{folder}/out") if n.startswith("batch_id="))
    assert kept == ["batch_id=4", "batch_id=5", "batch_id=6"]
    with pytest.raises(ValueError, match="another checkpoint"):
        jobs.stream_daily_stats(stream, f"{folder}/out", f"{folder}/cp2", available_now=True)
