"""Views of the model registry. The table is append-only; which model is active is derived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_active(registry: DataFrame) -> DataFrame:
    """Marks the run inserted last as the active one, whatever its training date."""
    order = F.struct("inserted_at", "id")
    last = registry.agg(F.max(order)).scalar()
    return registry.withColumn("is_active", order == last)


def register_views(log: DataFrame, registry: DataFrame) -> None:
    """Both tables under their SQL names, for `spark.sql`."""
    log.createOrReplaceTempView("predictions")
    with_active(registry).createOrReplaceTempView("model_metadata")


def model_history(registry: DataFrame) -> DataFrame:
    """Runs by training date, newest first."""
    return (
        with_active(registry)
        .orderBy(F.desc("trained_date"), F.desc("id"))
        .select(
            "model_name",
            "accuracy",
            "f1_score",
            "trained_date",
            "n_samples",
            "training_time",
            "is_active",
        )
    )


def metric_series(registry: DataFrame) -> DataFrame:
    """Accuracy and F1 over training dates, one row per run and metric."""
    return registry.select("id", "trained_date", "accuracy", "f1_score").unpivot(
        ["id", "trained_date"], ["accuracy", "f1_score"], "metric", "value"
    )


def registry_summary(registry: DataFrame) -> DataFrame:
    return registry.agg(
        F.count(F.lit(1)).alias("n_models"), F.max("accuracy").alias("best_accuracy")
    )
