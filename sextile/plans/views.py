"""The package's inputs, derived from the given tables as whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import quoted
from ..operators.metrics import confusion_counts, run_metrics


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labeled_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline is the first line of a document and description all the rest of it."""
    line_end = F.instr("text", "\n")
    lang, size = F.col("lang"), F.col("n_chars")
    category = (
        F.when(size < 200, "Legal")
        .when(size >= 5000, "Environmental")
        .when(lang == "en", "Political")
        .when(lang == "fr", "Economic")
        .when(lang == "de", "Social")
        .otherwise("Technological")
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"),
        F.substring_index("text", "\n", 1).alias("headline"),
        F.when(line_end > 0, F.substr("text", line_end + 1)).alias("description"),
        F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("topic_tags"),
        category.alias("category"),
        "source",
    )


def eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and predicted labels without a model; `Other` is predicted but never true."""
    articles = labeled_articles(spark, sf_dir)
    key = F.col("article_id")
    predicted = (
        F.when(key % 41 == 0, "Other")
        .when(key % 5 == 0, "Political")
        .when(key % 11 == 0, "Economic")
        .otherwise(F.col("category"))
    )
    return articles.select(
        "article_id", "source", F.col("category").alias("y_true"), predicted.alias("y_pred")
    )


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry with one run per source; the last inserted is not the last trained."""
    rows = run_metrics(confusion_counts(eval_pairs(spark, sf_dir), by=["source"]), ["source"])
    number = F.substr("source", F.lit(4)).cast("int")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (number * 7 % 20).cast("int"))
    return rows.select(
        number.cast("long").alias("id"),
        F.concat(F.lit("model_"), "source").alias("model_name"),
        "accuracy",
        "f1_score",
        F.col("precision").alias("precision_score"),
        F.col("recall").alias("recall_score"),
        day.alias("trained_date"),
        F.col("n_rows").alias("n_samples"),
        F.lit(1.0).alias("training_time"),
        F.timestamp_seconds(number).alias("inserted_at"),
    )


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of(table(spark, sf_dir, "events"))


def log_of(events: DataFrame) -> DataFrame:
    """Events, batch or stream, in the shape of the prediction log; some confidences are null."""
    kind = F.col("event_type")
    category = (
        F.when(kind == "click", "Political")
        .when(kind == "error", "Economic")
        .when(kind == "purchase", "Social")
        .when(kind == "signup", "Technological")
        .otherwise("Legal")
    )
    return events.select(
        F.col("event_id").alias("id"),
        F.col("props").alias("text"),
        category.alias("predicted_category"),
        F.when(F.col("event_id") % 50 != 0, F.col("value") / (F.col("value") + 10.0)).alias(
            "confidence"
        ),
        F.col("ts").alias("timestamp"),
        F.lit("Random Forest").alias("model_version"),
    )


def rounded(df: DataFrame, columns: Sequence[str], places: int = 6) -> DataFrame:
    """Doubles cut to comparable digits; sums of floats depend on their order."""
    names = set(columns)
    return df.select(
        *[F.round(quoted(c), places).alias(c) if c in names else quoted(c) for c in df.columns]
    )


def ranked(ordered: DataFrame) -> DataFrame:
    """Adds the place of each row of a short, ordered report, so that its order can be compared."""
    at = ordered.withColumn("_at", F.monotonically_increasing_id())
    return at.withColumn("rank", F.row_number().over(Window.orderBy("_at")).cast("long")).drop("_at")
