"""Evaluation of predictions. All figures come from one small table of (true, predicted) counts.

`confusion_counts` is the only pass over the rows: a map-side combined aggregate whose result has
at most one row per pair of labels (and group). Everything else reads that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import CATEGORIES


def confusion_counts(
    pairs: DataFrame, true_col: str = "y_true", pred_col: str = "y_pred", by: Sequence[str] = ()
) -> DataFrame:
    """Number of rows per true and predicted label."""
    return pairs.groupBy(
        *by, F.col(true_col).alias("y_true"), F.col(pred_col).alias("y_pred")
    ).agg(F.count(F.lit(1)).alias("n"))


def accuracy(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    hits = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    return counts.groupBy(*by).agg(
        ratio(hits, F.sum("n")).alias("accuracy"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")
    )


def label_figures(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hits, precision, recall, F1 and support of every label that is true or predicted somewhere.

    Each count is booked once under its true and once under its predicted label, so the union of
    labels needs neither a join nor a second pass. Undefined figures are 0.
    """
    none = F.lit(0).cast("long")
    n, hit = F.col("n"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(none)

    def entry(label: str, tp: Column, support: Column, predicted: Column) -> Column:
        return F.struct(
            F.col(label).alias("label"),
            tp.alias("tp"),
            support.alias("support"),
            predicted.alias("predicted"),
        )

    booked = F.array(entry("y_true", hit, n, none), entry("y_pred", none, none, n))
    sums = (
        counts.select(*by, F.explode(booked).alias("_b"))
        .groupBy(*by, F.col("_b.label").alias("label"))
        .agg(*[F.sum(f"_b.{c}").alias(c) for c in ("tp", "support", "predicted")])
    )
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return sums.select(
        *by,
        "label",
        "tp",
        _or_zero(tp, predicted).alias("precision"),
        _or_zero(tp, support).alias("recall"),
        _or_zero(2 * tp, support + predicted).alias("f1_score"),
        "support",
    )


def class_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return label_figures(counts, by).drop("tp")


def weighted_metrics(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support-weighted means over all labels, also those outside the category list."""
    return report.groupBy(*by).agg(*_support_means())


def run_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, weighted means and number of rows together, in one pass over the counts."""
    return (
        label_figures(counts, by)
        .groupBy(*by)
        .agg(
            ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
            *_support_means(),
            F.coalesce(F.sum("support"), F.lit(0)).alias("n_rows"),
        )
    )


def category_report(
    report: DataFrame, categories: Sequence[str] = CATEGORIES, places: int | None = None
) -> DataFrame:
    """The report of the known categories that occur, in list order; `places` rounds it."""
    shown = [
        (F.round(m, places) if places is not None else F.col(m)).alias(m)
        for m in ("precision", "recall", "f1_score")
    ]
    return (
        report.where(F.col("label").isin(*categories))
        .orderBy(_position("label", categories))
        .select(F.col("label").alias("category"), *shown, F.col("support").cast("long"))
    )


def metric_bars(report: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """One row per category and metric, for grouped bars."""
    return category_report(report, categories).unpivot(
        ["category"], ["precision", "recall", "f1_score"], "metric", "value"
    )


def confusion_cells(counts: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """The full grid over the categories; pairs outside it are dropped, empty cells are 0."""
    known = counts.where(F.col("y_true").isin(*categories) & F.col("y_pred").isin(*categories))
    grid = category_grid(counts.sparkSession, categories)
    # `known` has at most one row per cell of the grid.
    return (
        grid.join(F.broadcast(known), ["y_true", "y_pred"], "left")
        .orderBy("_row", "_column")
        .select("y_true", "y_pred", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    )


def confusion_wide(counts: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """One row per true category, one column per predicted one."""
    wide = (
        confusion_cells(counts, categories)
        .groupBy("y_true")
        .pivot("y_pred", list(categories))
        .agg(F.sum("n"))
    )
    return wide.orderBy(_position("y_true", categories))


def category_grid(spark: SparkSession, categories: Sequence[str]) -> DataFrame:
    """All pairs of categories, from the list itself."""
    names = F.lit(list(categories))
    rows = spark.range(1).select(F.posexplode(names).alias("_row", "y_true"))
    return rows.select("*", F.posexplode(names).alias("_column", "y_pred"))


def ratio(part: Column, whole: Column) -> Column:
    """A quotient as double, null where there is nothing to divide by."""
    return F.when(whole != 0, part.cast("double") / whole)


def _support_means() -> list[Column]:
    return [
        ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m)
        for m in ("precision", "recall", "f1_score")
    ]


def _or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def _position(column: str, categories: Sequence[str]) -> Column:
    return F.array_position(F.lit(list(categories)), F.col(column))
