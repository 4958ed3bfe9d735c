"""The prediction log, its figures, and the model registry."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sextile.operators import analytics as a
from sextile.operators import registry
from sextile.plans import rollup
from sextile.sources import store

LOG = "id long, text string, predicted_category string, confidence double, timestamp timestamp_ntz"
DAY1, DAY2 = datetime(2024, 1, 1, 10), datetime(2024, 1, 2, 10)


def log(spark):
    rows = [(i, f"t{i}", "Legal", 0.1, DAY1) for i in range(99)]
    rows += [(200, "u", "Legal", 0.9, DAY2), (300, "v", "Social", None, DAY2)]
    return spark.createDataFrame(rows, LOG)


def test_mean_of_daily_means_is_not_the_row_mean(spark):
    rollup = a.daily_rollup(log(spark))
    rows = a.category_confidence(rollup).collect()
    assert [r.predicted_category for r in rows] == ["Legal", "Social"]
    assert rows[0].avg_confidence == pytest.approx(0.5)
    assert rows[0].row_avg_confidence == pytest.approx((99 * 0.1 + 0.9) / 100)
    assert (rows[1].avg_confidence, rows[1].row_avg_confidence) == (None, None)
    summary = a.log_summary(rollup).first()
    assert (summary.total_predictions, summary.active_categories) == (101, 2)
    assert summary.avg_confidence == pytest.approx(0.5)


def test_stats_and_trends(spark):
    rollup = a.daily_rollup(log(spark))
    stats = a.prediction_stats(rollup)
    assert stats.columns == ["predicted_category", "count", "avg_confidence", "date"]
    assert [(r.predicted_category, str(r.date), r["count"]) for r in stats.collect()] == [
        ("Legal", "2024-01-02", 1),
        ("Social", "2024-01-02", 1),
        ("Legal", "2024-01-01", 99),
    ]
    assert [tuple(r) for r in a.category_totals(rollup).collect()] == [("Legal", 100), ("Social", 1)]
    assert [r["count"] for r in a.daily_totals(rollup).collect()] == [99, 2]
    assert a.daily_category_trend(rollup).count() == 3


def test_null_days_and_categories_are_left_out_of_trends(spark):
    rows = [(1, "a", None, 0.5, DAY1), (2, "b", "Legal", 0.5, None)]
    rollup = a.daily_rollup(spark.createDataFrame(rows, LOG))
    assert [r["count"] for r in a.daily_totals(rollup).collect()] == [1]
    assert a.daily_category_trend(rollup).count() == 0
    assert [tuple(r) for r in a.category_totals(rollup).collect()] == [("Legal", 1)]
    assert a.log_summary(rollup).first().total_predictions == 2


def test_recent(spark):
    rows = a.recent_predictions(log(spark), 3).collect()
    assert [r.text for r in rows] == ["v", "u", "t98"]
    dated = log(spark).withColumn("date", F.to_date("timestamp"))
    for n in (1, 2, 3, 50, 500):
        assert a.recent_predictions(dated, n).collect() == a.recent_predictions(log(spark), n).collect()


def test_histogram_and_share(spark):
    values = [0.0, 0.049, 0.05, 0.5, 0.999, 1.0, None]
    frame = spark.createDataFrame([(v,) for v in values], "confidence double")
    rows = a.confidence_histogram(frame).collect()
    assert [r.bin for r in rows] == list(range(20))
    assert {r.bin: r["count"] for r in rows if r["count"]} == {0: 2, 1: 1, 10: 1, 19: 2}
    assert rows[10].bin_start == 0.5 and rows[10].bin_end == 0.55
    assert len(a.confidence_histogram(frame, 4).collect()) == 4
    shares = a.category_share(log(spark)).collect()
    assert [r.share for r in shares] == pytest.approx([100 / 101, 1 / 101])


def test_value_counts(spark):
    frame = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "x string")
    assert [tuple(r) for r in a.value_counts(frame, "x").collect()] == [("b", 2), ("a", 1), ("c", 1)]


def test_empty_log(spark, folder):
    path, _ = store.create_tables(spark, folder)
    empty = store.read_log(spark, path)
    rollup = a.daily_rollup(empty)
    assert a.prediction_stats(rollup).count() == a.daily_totals(rollup).count() == 0
    assert tuple(a.log_summary(rollup).first()) == (0, None, None, 0)
    assert a.recent_predictions(empty).count() == a.category_share(empty).count() == 0
    assert {r["count"] for r in a.confidence_histogram(empty).collect()} == {0}


def test_append_and_read(spark, folder):
    path, _ = store.create_tables(spark, folder)
    long = "😀" * 600
    source = spark.createDataFrame(
        [(1, long, "Legal", 0.5, DAY1), (2, "b", "Social", None, DAY2)], LOG
    )
    store.append_predictions(
        store.log_rows(source, "id", version="v2", timestamp_col="timestamp"), path, many_days=True
    )
    store.create_tables(spark, folder)
    now = store.log_rows(source, "id")
    store.append_predictions(now, path)
    rows = store.read_log(spark, path).orderBy("id", "timestamp").collect()
    assert len(rows) == 4 and rows[0].text == long[:500]
    assert [r.model_version for r in rows] == ["v2", "Unknown", "v2", "Unknown"]
    assert str(rows[0].date) == "2024-01-01" and rows[0].confidence == 0.5
    assert rows[1].date == rows[1].timestamp.date()
    pruned = store.read_log(spark, path).where("date = DATE'2024-01-01'")
    assert "PartitionFilters: [isnotnull(date" in pruned._jdf.queryExecution().toString()
    assert pruned.count() == 1


def test_required_columns_of_the_log(spark, folder):
    path, _ = store.create_tables(spark, folder)
    for row in [(1, None, "Legal", 0.5, DAY1), (1, "x", None, 0.5, DAY1)]:
        bad = store.log_rows(spark.createDataFrame([row], LOG), "id")
        with pytest.raises(Exception, match="a log row has no"):
            store.append_predictions(bad, path)


def test_day_is_utc_in_any_session_zone(spark):
    frame = spark.sql("SELECT timestamp_seconds(1704070800) AS ts")  # 2024-01-01 01:00 UTC
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert str(frame.select(store.utc_date("ts")).first()[0]) == "2024-01-01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def metadata(accuracy, trained):
    return {
        "model_type": "Random Forest", "accuracy": accuracy, "f1_score": 0.5, "precision": 0.6,
        "recall": accuracy, "trained_date": trained.isoformat(), "training_time": 2.5,
        "n_samples": 100, "n_train": 80, "n_test": 20, "framework": "Spark ML",
    }


def test_registry(spark, folder):
    _, path = store.create_tables(spark, folder)
    stored = store.read_registry(spark, path)
    assert registry.model_history(stored).count() == 0
    assert tuple(registry.registry_summary(stored).first()) == (0, None)

    newer, older = datetime(2024, 5, 1, tzinfo=timezone.utc), datetime(2023, 5, 1, tzinfo=timezone.utc)
    first = store.append_model(spark, path, metadata(0.9, newer))
    second = store.append_model(spark, path, metadata(0.7, older))
    assert second > first
    stored = store.read_registry(spark, path)
    history = registry.model_history(stored).collect()
    assert [r.accuracy for r in history] == [0.9, 0.7]
    assert [r.is_active for r in history] == [False, True]
    assert len(history[0]) == 7
    assert tuple(registry.registry_summary(stored).first()) == (2, 0.9)
    series = registry.metric_series(stored)
    assert series.columns == ["id", "trained_date", "metric", "value"] and series.count() == 4


def test_sql_over_both_tables(spark, folder):
    log_path, path = store.create_tables(spark, folder)
    store.append_predictions(
        store.log_rows(log(spark), "id", timestamp_col="timestamp"), log_path, many_days=True
    )
    store.append_model(spark, path, metadata(0.9, datetime(2024, 5, 1, tzinfo=timezone.utc)))
    registry.register_views(store.read_log(spark, log_path), store.read_registry(spark, path))
    stats = spark.sql(
        """SELECT predicted_category, COUNT(*) AS count, AVG(confidence) AS avg_confidence,
                  DATE(timestamp) AS date
           FROM predictions GROUP BY predicted_category, DATE(timestamp)
           ORDER BY MAX(timestamp) DESC, predicted_category"""
    )
    expected = a.prediction_stats(a.daily_rollup(log(spark)))
    assert [(r[0], r[1], str(r[3])) for r in stats.collect()] == [
        (r[0], r[1], str(r[3])) for r in expected.collect()
    ]
    latest = spark.sql("SELECT text FROM predictions ORDER BY timestamp DESC, id DESC LIMIT 20")
    assert [r.text for r in latest.collect()][:2] == ["v", "u"]
    active = spark.sql("SELECT model_name, accuracy FROM model_metadata WHERE is_active")
    assert [tuple(r) for r in active.collect()] == [("Random Forest", 0.9)]


def test_utc_days_in_any_zone(spark, folder):
    """Days of the figures are UTC days, and zoneless times are UTC, wherever the session is."""
    rows = [(1, "2024-01-02 01:00:00"), (2, "2024-01-02 23:30:00"), (3, "2024-01-03 00:10:00")]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        frame = spark.createDataFrame(rows, "id long, at string").selectExpr(
            "id", "'t' AS text", "'Legal' AS predicted_category", "0.5D AS confidence",
            "to_timestamp_ntz(at) AS timestamp",
        )
        want = {("2024-01-02", 2), ("2024-01-03", 1)}
        logged = store.log_rows(frame, "id", timestamp_col="timestamp")
        for each in (frame, logged.drop("date"), logged):
            got = a.daily_rollup(each).selectExpr("cast(date AS string) AS d", "count").collect()
            assert {tuple(r) for r in got} == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_recent_days_and_rollup_read_only_their_partitions(spark, folder):
    path, _ = store.create_tables(spark, folder)
    assert store.log_days(spark, path) == []
    assert store.read_recent_log(spark, path, 5).count() == 0
    frame = spark.range(60).selectExpr(
        "id", "'t' AS text", "'Legal' AS predicted_category", "0.5D AS confidence",
        "timestamp_ntz '2024-01-01 12:00:00' + make_interval(0, 0, 0, cast(id % 12 AS int)) AS timestamp",
    )
    rows = store.log_rows(frame, "id", timestamp_col="timestamp")
    store.append_predictions(rows, path, many_days=True)
    days = store.log_days(spark, path)
    assert [str(d) for d in (days[0], days[-1])] == ["2024-01-12", "2024-01-01"] and len(days) == 12
    recent = store.read_recent_log(spark, path, 8)
    assert len(recent.inputFiles()) >= 1
    assert {r.date for r in recent.select("date").distinct().collect()} == set(days[:2])
    log = store.read_log(spark, path)
    assert a.recent_predictions(recent, 8).collect() == a.recent_predictions(log, 8).collect()
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    rollup.update_rollup(log, f"{folder}/rollup")
    rollup.update_rollup(log, f"{folder}/rollup", days[:1])
    rollup.update_rollup(log, f"{folder}/rollup", [])
    got = rollup.read_rollup(spark, f"{folder}/rollup")
    assert {(r.date, r["count"]) for r in got.collect()} == {(d, 5) for d in days}
    assert a.between(got, days[3], days[1]).count() == 3
