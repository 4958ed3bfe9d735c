"""Exact stratified train/test split without a sort of any whole class."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import SEED
from ..sources.shared import BROADCAST_ROWS

# Lengths of the hash prefixes, in hex digits, by which the cut of a class is found.
# The first keeps the counts of a map task to 256 rows a class; the last leaves one row in a million.
PREFIX_LENGTHS = (2, 5)

# So many rows of a class can be ranked by one task without ado.
RANKED_ROWS = 100_000


@dataclass(frozen=True)
class Split:
    """The input rows with a column `split`, and the exact sizes behind it."""

    rows: DataFrame
    class_counts: dict[str, int]
    train_quotas: dict[str, int]

    @property
    def classes(self) -> list[str]:
        return sorted(self.class_counts)

    @property
    def n_samples(self) -> int:
        return sum(self.class_counts.values())

    @property
    def n_train(self) -> int:
        return sum(self.train_quotas.values())

    @property
    def n_test(self) -> int:
        return self.n_samples - self.n_train


def train_quotas(class_counts: Mapping[str, int], test_percent: int = 20) -> dict[str, int]:
    """Training rows per class."""
    total = sum(class_counts.values())
    return shares(class_counts, total - -(-total * test_percent // 100))


def shares(class_counts: Mapping[str, int], n: int) -> dict[str, int]:
    """`n` rows by class: floor shares, then one more to the largest remainders.

    Whole-number arithmetic; equal remainders go to the smaller label.
    """
    total = sum(class_counts.values())
    quotas = {label: count * n // total for label, count in class_counts.items()}
    by_remainder = sorted(class_counts, key=lambda c: (-(class_counts[c] * n % total), c))
    for label in by_remainder[: n - sum(quotas.values())]:
        quotas[label] += 1
    return quotas


def check_classes(class_counts: Mapping[str | None, int], test_percent: int = 20) -> None:
    """Fail before any fit on labels that cannot be stratified."""
    if not class_counts:
        raise ValueError("no rows to split")
    if None in class_counts:
        raise ValueError(f"{class_counts[None]} rows have no label")
    single = sorted(label for label, count in class_counts.items() if count < 2)
    if single:
        raise ValueError(f"classes with a single row cannot be split: {', '.join(single)}")
    total, k = sum(class_counts.values()), len(class_counts)
    n_test = -(-total * test_percent // 100)
    if n_test < k or total - n_test < k:
        raise ValueError(f"{total} rows are too few to hold {k} classes in both parts")


def stratified_split(
    df: DataFrame,
    id_col: str,
    label_col: str,
    test_percent: int = 20,
    seed: int = SEED,
    n_train: int | None = None,
) -> Split:
    """Assign every row to 'train' or 'test', with exact quotas per class.

    With `n_train`, so many rows are 'train', however small a class's part becomes.

    A row's place is its rank by md5(seed|id) within its class. Ranking a class would put a third
    of all rows into one sort, so only the cut of each class is looked for. Counts per hash prefix
    give the prefix at which the quota is reached; where it has many rows, the same again with
    longer prefixes among those rows only; and the rows that share the last prefix are ranked.
    Every count is combined on the map side. The final pass compares each row with its class's cut and shuffles
    nothing. `id_col` must be unique and, like the label, the same at every read.
    """
    spark = df.sparkSession
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    keys = df.select(
        F.col(label_col).alias("_label"), key.alias("_key"), F.col(id_col).alias("_id")
    )
    first, *longer = PREFIX_LENGTHS
    histogram = _prefix_counts(keys, first).persist()
    try:
        # The list of classes is part of the model and lives on the driver in any case.
        totals = histogram.groupBy("_label").agg(F.sum("_n").alias("_n"))
        class_counts = {row["_label"]: row["_n"] for row in totals.collect()}
        if n_train is None:
            check_classes(class_counts, test_percent)
            quotas = train_quotas(class_counts, test_percent)
        else:
            quotas = shares(class_counts, min(n_train, sum(class_counts.values())))
        edges = _edges(histogram, _per_class(spark, quotas.items(), "_quota long"))
    finally:
        histogram.unpersist()
    for length in longer:
        if all(edge.n <= RANKED_ROWS for edge in edges):
            break
        inside = _at_edge(keys, edges)
        wanted = [(edge.label, edge.left) for edge in edges]
        edges = _edges(_prefix_counts(inside, length), _per_class(spark, wanted, "_quota long"))

    within = Window.partitionBy("_label").orderBy("_key", "_id")
    cuts = (
        _at_edge(keys, edges)
        .withColumn("_rank", F.row_number().over(within))
        .where("_rank = _left")
        .select("_label", "_key", "_id")
        .collect()
    )
    id_type = df.schema[id_col].dataType.simpleString()
    cut = _per_class(spark, [tuple(c) for c in cuts], f"_cut_key string, _cut_id {id_type}")
    before = (key < F.col("_cut_key")) | (
        (key == F.col("_cut_key")) & (F.col(id_col) <= F.col("_cut_id"))
    )
    rows = (
        df.join(cut, F.col(label_col) == F.col("_label"), "left")
        .withColumn("split", F.when(before, "train").otherwise("test"))
        .drop("_label", "_cut_key", "_cut_id")
    )
    return Split(rows, class_counts, quotas)


def _prefix_counts(keys: DataFrame, length: int) -> DataFrame:
    return keys.groupBy("_label", F.substring("_key", 1, length).alias("_prefix")).agg(
        F.count(F.lit(1)).alias("_n")
    )


class _Edge(NamedTuple):
    """The prefix in which a class reaches its quota, how many of its rows are within, and all."""

    label: str
    prefix: str
    left: int
    n: int


def _edges(counts: DataFrame, quotas: DataFrame) -> list[_Edge]:
    up_to = Window.partitionBy("_label").orderBy("_prefix")
    running = counts.select("*", F.sum("_n").over(up_to).alias("_running"))
    reached = running.join(quotas, "_label").where("_running >= _quota AND _running - _n < _quota")
    left = F.expr("_quota - _running + _n").alias("_left")
    return [_Edge(*row) for row in reached.select("_label", "_prefix", left, "_n").collect()]


def _at_edge(keys: DataFrame, edges: list[_Edge]) -> DataFrame:
    """The rows of each class whose hash starts with the class's edge."""
    edge = _per_class(keys.sparkSession, edges, "_prefix string, _left long, _n long")
    return keys.join(edge, "_label").where(F.startswith("_key", "_prefix"))


def split_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _per_class(spark, rows, columns: str) -> DataFrame:
    """One row per class; broadcast unless there are very many classes."""
    rows = [tuple(r) for r in rows]
    schema = T.StructType([T.StructField("_label", T.StringType())])
    for field in T._parse_datatype_string(columns).fields:
        schema = schema.add(field)
    frame = spark.createDataFrame(rows, schema)
    return F.broadcast(frame) if len(rows) <= BROADCAST_ROWS else frame
