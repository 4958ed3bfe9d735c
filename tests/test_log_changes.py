"""The log under repeated appends and compactions, and the live store of its figures."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sextile.operators import analytics
from sextile.plans import queries, rollup, scoring
from sextile.sources import bundle, catalog, store
from sextile.sources.shared import children, new_path, read_text, write_text
from sextile.streaming import jobs

SF = "/root/testdata/sf0.001"


def rows(spark, ids, category="Legal", days=3):
    made = [(i, f"text {i}", category, i % 10 / 10, datetime(2024, 1, 1 + i % days, 12)) for i in ids]
    frame = spark.createDataFrame(
        made, "id long, text string, predicted_category string, confidence double, at timestamp_ntz"
    )
    return store.log_rows(frame, "id", timestamp_col="at")


def ids(spark, path):
    return sorted(r.id for r in store.read_log(spark, path).select("id").collect())


def test_small_files_are_whole_or_absent(spark, folder):
    write_text(spark, f"{folder}/a", "one é")
    assert read_text(spark, f"{folder}/a") == "one é" and read_text(spark, f"{folder}/b") is None
    with pytest.raises(Exception):
        write_text(spark, f"{folder}/a", "two")
    write_text(spark, f"{folder}/a", "three", overwrite=True)
    assert read_text(spark, f"{folder}/a") == "three"


def test_repeated_batches_replace_themselves(spark, folder):
    path, _ = store.create_tables(spark, folder)
    store.append_predictions(rows(spark, range(5)), path)
    store.append_predictions(rows(spark, range(10, 20)), path, batch="b")
    # An attempt that was interrupted before its commit is not part of the log.
    rows(spark, [99]).write.partitionBy("date").parquet(f"{path}/_batches/{store._key('b')}/broken")
    assert ids(spark, path) == [*range(5), *range(10, 20)]
    store.append_predictions(rows(spark, range(10, 13)), path, batch="b")
    store.append_predictions(rows(spark, [30]), path, many_days=True, batch="c")
    assert ids(spark, path) == [*range(5), 10, 11, 12, 30]
    assert [r.id for r in store.read_recent_log(spark, path, 1).where("id >= 10").collect()] == [11]


def test_compaction_keeps_every_row_once(spark, folder):
    path, _ = store.create_tables(spark, folder)
    for i in range(4):
        store.append_predictions(rows(spark, range(10 * i, 10 * i + 5)), path, batch=f"b{i}")
    store.append_predictions(rows(spark, range(100, 105)), path)
    want = ids(spark, path)
    reading = store.read_log(spark, path)
    files = len(reading.inputFiles())
    assert store.compact_log(spark, path) == files
    assert ids(spark, path) == want and len(store.read_log(spark, path).inputFiles()) <= 3
    # A reader that has started goes on with the files of before.
    assert reading.count() == len(want)
    store.append_predictions(rows(spark, range(10)), path, batch="b1")
    assert ids(spark, path) == want
    store.append_predictions(rows(spark, [200]), path, batch="b9")
    store.compact_log(spark, path)
    store.expire_replaced(spark, path)
    assert ids(spark, path) == [*want, 200]
    assert store.compact_log(spark, path, below=1) == 0
    plan = store.read_log(spark, path).where("date = DATE '2024-01-01'")._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(date" in plan.toString()


def test_one_of_two_compactions_fails(spark, folder, monkeypatch):
    path, _ = store.create_tables(spark, folder)
    for i in range(3):
        store.append_predictions(rows(spark, [i]), path)
    before = store._manifest(spark, path)
    store.compact_log(spark, path)
    monkeypatch.setattr(store, "_manifest", lambda *_: before)
    with pytest.raises(Exception, match="FileAlreadyExists|already exists"):
        store.compact_log(spark, path)
    monkeypatch.undo()
    assert ids(spark, path) == [0, 1, 2]


def test_live_figures(spark, folder):
    log = rows(spark, range(60)).unionByName(rows(spark, range(60, 90), "Social"))
    for number in (0, 1, 2):
        rollup.add_batch(log.where(F.col("id") % 3 == number), folder, "s", number)
        rollup.add_batch(log.where(F.col("id") % 3 == number), folder, "s", number)
        if number == 1:
            assert rollup.merge_batches(spark, folder) == 2
    rollup.add_batch(log.where("id % 3 = 0"), folder, "s", 0)
    state = rollup.read_live(spark, folder)
    live = analytics.rollup_of(state).drop("bins", "texts")
    want = analytics.daily_rollup(log)
    key = ["predicted_category", "date", "count", "confidence_count", "last_timestamp"]
    assert live.select(key).exceptAll(want.select(key)).count() == 0 and live.count() == want.count()
    both = live.join(want, ["predicted_category", "date"]).where(
        F.abs(live.avg_confidence - want.avg_confidence) > 1e-9
    )
    assert both.count() == 0
    some = analytics.between(state, date(2024, 1, 2), date(2024, 1, 3))
    bins = analytics.confidence_histogram(analytics.between(log, date(2024, 1, 2), date(2024, 1, 3)))
    assert [r["count"] for r in analytics.state_histogram(some).orderBy("bin").collect()] == [
        r["count"] for r in bins.orderBy("bin").collect()
    ]
    assert rollup.merge_batches(spark, folder) == 1 and children(spark, f"{folder}/batches") == []
    assert rollup.read_live(spark, folder).count() == want.count()
    empty = rollup.read_live(spark, f"{folder}-none")
    assert analytics.state_summary(empty).first().total_predictions == 0
    assert sum(r["count"] for r in analytics.state_histogram(empty).collect()) == 0


def test_sketch_of_texts_and_plan(spark, folder):
    log = rows(spark, range(20_000), days=9)
    for number in (0, 1):
        rollup.add_batch(log.where(F.col("id") % 4 != number), folder, "s", number)
    state = analytics.between(rollup.read_live(spark, folder), date(2024, 1, 2), date(2024, 1, 7))
    true = log.where("date BETWEEN '2024-01-02' AND '2024-01-07'").select("text").distinct().count()
    found = analytics.state_summary(state).first()
    assert abs(found.distinct_texts - true) < 0.05 * true
    plan = queries.histogram_between(spark, SF)._jdf.queryExecution().toString()
    assert "events.parquet" not in plan and "live-" in plan


def test_a_stream_follows_the_active_model(spark, folder):
    trained = queries.small_model(spark, SF)
    models, (log_path, registry) = f"{folder}/models", store.create_tables(spark, folder)
    source, checkpoint = f"{folder}/source", f"{folder}/checkpoint"
    made = 0

    def arrive(n):
        nonlocal made
        frame = spark.range(made, made + n).selectExpr("id AS doc_id", "concat('some words ', id) AS text")
        frame.coalesce(1).write.mode("append").parquet(source)
        made += n

    def register(name):
        bundle.save_model(spark, trained.model, trained.metadata, models, name)
        return f"{name} {store.append_model(spark, registry, trained.metadata | {'model_type': name})}"

    def run():
        stream = jobs.read_stream(spark, source, spark.read.parquet(source).schema, files_per_trigger=1)
        jobs.stream_active_scores(
            stream, models, registry, log_path, checkpoint, "doc_id", available_now=True
        ).awaitTermination()

    first = register("first")
    arrive(4)
    run()
    second = register("second")
    arrive(3)
    run()
    arrive(2)
    run()
    got = {r.id: r.model_version for r in store.read_log(spark, log_path).collect()}
    assert got == {i: first if i < 4 else second for i in range(9)}
    # The last micro-batch is repeated, as after a failure before its end was noted.
    last = max(int(n) for n in children(spark, f"{checkpoint}/commits") if n.isdigit())
    (store.delete)(spark, f"{checkpoint}/commits/{last}")
    run()
    assert sorted(r.id for r in store.read_log(spark, log_path).collect()) == list(range(9))


def test_one_text_equals_the_frame(spark):
    model = queries.small_model(spark, SF).model
    turns = spark.read.parquet(f"{SF}/conversations.parquet").where("text IS NOT NULL").select("text")
    odd = spark.createDataFrame([("",), (" \n",), ("Ü:text 'x' \\ $1",), ("unknownword",)], "text string")
    scored = scoring.score(model, turns.union(odd), probabilities=True).collect()
    spark.sparkContext.setJobGroup("single", "one text")
    try:
        seconds = []
        for row in scored:
            started = datetime.now()
            one = scoring.predict(spark, model, row.text)
            seconds.append(datetime.now() - started)
            assert one["category"] == row.predicted_category
            assert one["confidence"] == pytest.approx(row.confidence, abs=1e-12)
            assert one["probabilities"] == pytest.approx(row.probabilities, abs=1e-12)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("single")
        assert sorted(seconds)[len(seconds) // 2] < timedelta(seconds=0.5)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    with pytest.raises(ValueError):
        scoring.predict(spark, model, None)


def test_catalog_tables_follow_the_log(spark, folder):
    path, registry_path = store.create_tables(spark, folder)
    name = "log_" + folder.rsplit("/", 1)[-1].replace("-", "_").lower() + "_catalog"

    def seen():
        return sorted(r.id for r in spark.table(name).select("id").collect())

    assert catalog.publish_log(spark, path, name).count() == 0
    store.append_predictions(rows(spark, range(30)), path)
    store.append_predictions(rows(spark, range(30, 50)), path, batch="a'b")
    catalog.publish_log(spark, path, name)
    assert seen() == ids(spark, path) == [*range(50)]
    # Plain appends to a day that a compaction has merged stand beside replaced files.
    store.compact_log(spark, path)
    store.append_predictions(rows(spark, range(50, 60)), path)
    catalog.publish_log(spark, path, name)
    assert seen() == ids(spark, path) == [*range(60)]
    store.expire_replaced(spark, path)
    catalog.publish_log(spark, path, name)
    assert seen() == [*range(60)]
    one_day = spark.sql(f"SELECT id FROM {name} WHERE date = DATE '2024-01-02'")
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and one_day.count() == 20
    assert len(one_day.inputFiles()) < len(spark.table(name).inputFiles())
    size = one_day._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size < spark.table(name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**40
    spark.sql(f"DROP TABLE {name}")
    assert ids(spark, path) == [*range(60)]
    runs = catalog.publish_registry(spark, registry_path, f"{name}_runs")
    assert runs.count() == 0 and runs.columns == store.REGISTRY_SCHEMA.names


def test_catalog_has_what_streams_wrote(spark, folder):
    path, _ = store.create_tables(spark, f"{folder}/store")
    name = "log_" + folder.rsplit("/", 1)[-1].replace("-", "_").lower() + "_streams"
    model = queries.small_model(spark, SF).model
    source = queries._source_stream(spark, SF, "documents")
    store.append_predictions(rows(spark, [-1, -2]), path)
    jobs.stream_scores(model, source, path, f"{folder}/cp", "doc_id", available_now=True).awaitTermination()
    catalog.publish_log(spark, path, name)
    assert sorted(r.id for r in spark.table(name).collect()) == ids(spark, path)
