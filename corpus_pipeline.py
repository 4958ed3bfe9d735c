"""From raw documents to packed training sequences, as stages over tables.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs` and returns a DataFrame, which is
written as Parquet and read again as the next one's `docs`. All stages but the last return rows of
`docs` with all its columns, whatever others there are; nulls, empty tables and repeated rows are
treated as each operator says. Rows without a `doc_id` do not pass the first stage. Of rows with
equal ids, which are copies of each other, the two stages against duplicates keep one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextile.llm import decontaminate, exact, langid, near, packing
from sextile.llm.queries import send_code, settled, table
from sextile.sources.shared import BROADCAST_ROWS, Scratch, materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without a letter or of another script go.

    The profiles are learned from the labelled documents of the table, as in the query of its own.
    """
    send_code(spark)
    labelled = table(spark, sf_dir, "documents")
    profiles = langid.learn(labelled)
    return langid.known_only(docs.where("doc_id IS NOT NULL"), profiles)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id."""

    def build(scratch):
        groups = exact.exact_groups(docs, scratch)
        return groups.where("doc_id <> keep_id").select("doc_id")

    return _without(_once(docs), settled(spark, "dropped", build))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, by five words and 0.8: the smallest id."""

    def build(scratch):
        classes = near.near_duplicates(docs, scratch)
        return classes.where("doc_id <> component_id").select("doc_id")

    return _without(_once(docs), settled(spark, "dropped", build))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    items = table(spark, sf_dir, "benchmark")

    def build(scratch):
        return decontaminate.leaks(docs, items).select("doc_id").distinct()

    return _without(docs, settled(spark, "dropped", build))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids, in sequences."""
    return settled(spark, "packed", lambda scratch: packing.pack(docs, scratch))


def _all(docs: DataFrame) -> list[str]:
    """All columns by quoted name, in their order."""
    return ["`" + name.replace("`", "``") + "`" for name in docs.columns]


def _once(docs: DataFrame) -> DataFrame:
    """One row of each id: that with the smallest text.

    Only ids are counted, with partial sums; rows move only if some id recurs, and then just its rows.
    """
    again = materialize(
        docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"),
        "repeated",
    )
    n = again.count()
    if not n:
        return docs
    ids = F.broadcast(again) if n <= BROADCAST_ROWS else again
    names = _all(docs)
    rows = docs.join(ids, "doc_id", "left_semi").select(*names)
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    first = rows.groupBy("doc_id").agg(F.min_by(row, F.coalesce("text", F.lit(""))).alias("_row"))
    one = first.select(*[F.col(f"_row.c{i}") for i in range(len(names))]).toDF(*docs.columns)
    return docs.join(ids, "doc_id", "left_anti").select(*names).union(one)


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Documents whose id is not among the dropped ones.

    Those are sent to all tasks (8 bytes each) if they were counted and are few, and then no text is
    shuffled; more of them are joined.
    """
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    left = docs.where("doc_id IS NOT NULL").join(dropped, "doc_id", "left_anti")
    return left.select(*_all(docs))


STAGES = [
    ("language", known_language),
    ("exact", without_copies),
    ("near", without_near_copies),
    ("leaks", without_leaks),
    ("packing", packed),
]

# Language profiles, signatures and tokens are beyond SQL; a test runs a plain version beside it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the table of documents.

    What a stage left is deleted once all are done; only the packed pieces stay.
    """
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        # The pieces are a written table already.
        return STAGES[-1][1](spark, docs, sf_dir)
