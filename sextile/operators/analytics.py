"""Figures over the prediction log.

`daily_rollup` is the one pass over the log. Its result has a row per category and day, and all
other tables are built on it, so a caller can materialise it once for a whole page.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import utc_day
from .metrics import ratio


def between(df: DataFrame, since: date | None = None, until: date | None = None) -> DataFrame:
    """Rows of the UTC days from `since` to `until`, both included, if given.

    Of a stored log or rollup, no other days are read.
    """
    if since is not None:
        df = df.where(utc_day(df) >= F.lit(since))
    if until is not None:
        df = df.where(utc_day(df) <= F.lit(until))
    return df


def daily_rollup(log: DataFrame) -> DataFrame:
    """Figures by category and UTC day."""
    return log.groupBy("predicted_category", utc_day(log).alias("date")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("confidence").alias("avg_confidence"),
        F.sum("confidence").alias("confidence_sum"),
        F.count("confidence").alias("confidence_count"),
        F.max("timestamp").alias("last_timestamp"),
    )


BINS = 20


def daily_state(log: DataFrame, bins: int = BINS) -> DataFrame:
    """What can be merged of the figures by category and UTC day, for a store that grows.

    Beside sums and counts: the rows of each confidence bin, and a sketch of the distinct texts.
    """
    day = utc_day(log).alias("date")
    # Bins are counted by themselves first, so that a day's vector is put together from `bins` rows.
    cells = log.groupBy("predicted_category", day, _bin(bins)).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("confidence").alias("confidence_sum"),
        F.count("confidence").alias("confidence_count"),
        F.max("timestamp").alias("last_timestamp"),
        F.hll_sketch_agg("text").alias("texts"),
    )
    in_bin = lambda i: F.sum(F.when(F.col("bin") == i, F.col("n")).otherwise(0))
    return cells.groupBy("predicted_category", "date").agg(
        F.sum("n").alias("count"),
        F.sum("confidence_sum").alias("confidence_sum"),
        F.sum("confidence_count").alias("confidence_count"),
        F.max("last_timestamp").alias("last_timestamp"),
        F.array(*[in_bin(i) for i in range(bins)]).alias("bins"),
        F.hll_union_agg("texts").alias("texts"),
    )


def merged_state(states: DataFrame, bins: int = BINS) -> DataFrame:
    """One row for each category and day of several `daily_state` tables."""
    return states.groupBy("predicted_category", "date").agg(
        F.sum("count").alias("count"),
        F.sum("confidence_sum").alias("confidence_sum"),
        F.sum("confidence_count").alias("confidence_count"),
        F.max("last_timestamp").alias("last_timestamp"),
        F.array(*[F.sum(F.col("bins")[i]) for i in range(bins)]).alias("bins"),
        F.hll_union_agg("texts").alias("texts"),
    )


def rollup_of(state: DataFrame) -> DataFrame:
    """A merged state as the rollup that the reports are made from."""
    return state.withColumn("avg_confidence", ratio(F.col("confidence_sum"), F.col("confidence_count")))


def state_histogram(state: DataFrame, bins: int = BINS) -> DataFrame:
    """Rows per confidence bin, exact, from the state of some days."""
    sums = state.agg(F.array(*[F.coalesce(F.sum(F.col("bins")[i]), F.lit(0)) for i in range(bins)]).alias("n"))
    return sums.select(F.posexplode("n").alias("bin", "count")).select(
        "bin",
        (F.col("bin") / bins).alias("bin_start"),
        ((F.col("bin") + 1) / bins).alias("bin_end"),
        "count",
    )


def state_summary(state: DataFrame) -> DataFrame:
    """Totals of some days: rows, active categories, and about how many distinct texts.

    The number of texts is a sketch's, within a few percent; the others are exact.
    """
    return state.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_predictions"),
        ratio(F.sum("confidence_sum"), F.sum("confidence_count")).alias("row_avg_confidence"),
        F.count_distinct("predicted_category").alias("active_categories"),
        F.hll_sketch_estimate(F.hll_union_agg("texts")).alias("distinct_texts"),
    )


def _bin(bins: int) -> Column:
    """The confidence bin of a row, null without a confidence."""
    index = F.floor(F.col("confidence") * bins).cast("int")
    bounded = F.greatest(F.lit(0), F.least(index, F.lit(bins - 1)))
    return F.when(F.col("confidence").isNotNull(), bounded).alias("bin")


def prediction_stats(rollup: DataFrame) -> DataFrame:
    """Count and mean confidence by category and day, the latest prediction first."""
    return rollup.orderBy(F.desc("last_timestamp"), "predicted_category").select(
        "predicted_category", "count", "avg_confidence", "date"
    )


def category_totals(rollup: DataFrame) -> DataFrame:
    return (
        rollup.where(F.col("predicted_category").isNotNull())
        .groupBy("predicted_category")
        .agg(F.sum("count").alias("count"))
        .orderBy("predicted_category")
    )


def category_confidence(rollup: DataFrame) -> DataFrame:
    """Mean of the daily means per category, highest first; the mean over rows beside it."""
    return (
        rollup.where(F.col("predicted_category").isNotNull())
        .groupBy("predicted_category")
        .agg(
            F.avg("avg_confidence").alias("avg_confidence"),
            ratio(F.sum("confidence_sum"), F.sum("confidence_count")).alias("row_avg_confidence"),
        )
        .orderBy(F.desc("avg_confidence"), "predicted_category")
    )


def daily_totals(rollup: DataFrame) -> DataFrame:
    return (
        rollup.where(F.col("date").isNotNull())
        .groupBy("date")
        .agg(F.sum("count").alias("count"))
        .orderBy("date")
    )


def daily_category_trend(rollup: DataFrame) -> DataFrame:
    return (
        rollup.where(F.col("date").isNotNull() & F.col("predicted_category").isNotNull())
        .groupBy("date", "predicted_category")
        .agg(F.sum("count").alias("count"))
        .orderBy("date", "predicted_category")
    )


def log_summary(rollup: DataFrame) -> DataFrame:
    """Totals over the whole log, one row also for an empty one."""
    return rollup.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_predictions"),
        F.avg("avg_confidence").alias("avg_confidence"),
        ratio(F.sum("confidence_sum"), F.sum("confidence_count")).alias("row_avg_confidence"),
        F.count_distinct("predicted_category").alias("active_categories"),
    )


def recent_predictions(log: DataFrame, n: int = 20) -> DataFrame:
    """The latest predictions; of equal times the larger id first.

    Of a stored log, `sources.store.read_recent_log` gives the days that matter.
    """
    return (
        log.orderBy(F.desc("timestamp"), F.desc("id"))
        .limit(n)
        .select("text", "predicted_category", "confidence", "timestamp")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first, nulls left out."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), column)
    )


def category_share(scored: DataFrame, column: str = "predicted_category") -> DataFrame:
    """Rows and share of the whole per category."""
    known = scored.where(F.col(column).isNotNull())
    counts = known.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = known.agg(F.count(F.lit(1))).scalar()
    return counts.select(column, "count", ratio(F.col("count"), total).alias("share")).orderBy(
        F.desc("count"), column
    )


def confidence_histogram(scored: DataFrame, bins: int = 20) -> DataFrame:
    """Rows per confidence bin of equal width on [0, 1], empty bins included."""
    index = F.floor(F.col("confidence") * bins).cast("int")
    bounded = F.greatest(F.lit(0), F.least(index, F.lit(bins - 1))).alias("bin")
    counts = (
        scored.where(F.col("confidence").isNotNull())
        .groupBy(bounded)
        .agg(F.count(F.lit(1)).alias("count"))
    )
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    # `counts` has at most one row per bin.
    return (
        every.join(F.broadcast(counts), "bin", "left")
        .orderBy("bin")
        .select(
            "bin",
            (F.col("bin") / bins).alias("bin_start"),
            ((F.col("bin") + 1) / bins).alias("bin_end"),
            F.coalesce("count", F.lit(0).cast("long")).alias("count"),
        )
    )
