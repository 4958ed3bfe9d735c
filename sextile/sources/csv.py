"""CSV in and out, and checks of its columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import ARTICLE_COLUMNS, TEXT_COLUMN
from ..functions.text import null_if_na, quoted
from .shared import Scratch, stored_bytes


_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail with all missing and all available names; letter case matters."""
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(
            f"missing required columns: {', '.join(missing)};"
            f" available columns: {', '.join(df.columns)}"
        )
    return df


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All columns as strings under the names in the header, missing-value words as null.

    With `multi_line` a quoted field may hold line breaks, and then one file is one task. Give
    many files, or `multi_line=False` where no field holds a break, or use `land_csv`, which reads one
    file in many tasks.
    """
    raw = spark.read.options(**_OPTIONS).csv(
        path, header=True, inferSchema=False, multiLine=multi_line
    )
    return raw.select(*[null_if_na(quoted(name)).alias(name) for name in raw.columns])


# A source is cut into about so many blocks at most if they are smaller than the session's own: each is a
# task of several stages, whose reports all go to the driver.
MANY_BLOCKS = 256

# Where a line stands in its file, and what is known of the records around it.
_FILE, _BLOCK, _LINE = "_file", "_block", "_line"


def split_records(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """The records of CSV files as strings, each file read in as many tasks as it has blocks.

    Columns: `file`, `number` (from 1 in each file; within a block's own records the number is exact, and
    it is unique) and `value`. A line begins a record if the quotes before it in its file are even in number:
    quotes are counted for each block of the text source and summed up over blocks, a row for each
    block. Within its block every line then finds its record, and only the first and the last record of a
    block, which may go on in a neighbour, are put together across blocks. Quotes must stand around
    fields or doubled inside them, as all CSV writers have them.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.file_block_start").alias(_BLOCK),
        F.monotonically_increasing_id().alias(_LINE),
        "value",
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"),
    )
    block = [_FILE, _BLOCK]
    earlier = Window.partitionBy(_FILE).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each block of some megabytes.
    parity = scratch.table(
        lines.groupBy(*block)
        .agg(F.sum("quotes").alias("quotes"))
        .select(*block, F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("open")),
        "csv-blocks",
    )
    before = Window.partitionBy(*block).orderBy(_LINE).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*block).orderBy(_LINE).rowsBetween(Window.unboundedPreceding, 0)
    quoted_before = F.col("open") + F.coalesce(F.sum("quotes").over(before), F.lit(0))
    numbered = (
        lines.join(F.broadcast(parity), block)
        .withColumn("starts", (quoted_before % 2 == 0).cast("int"))
        .withColumn("record", F.sum("starts").over(upto))
    )
    # Lines of a block are in one task by now, so this shuffles nothing.
    pieces = scratch.table(
        numbered.groupBy(*block, "record").agg(_joined(F.struct(_LINE, "value")).alias("value")),
        "csv-pieces",
    )
    last = pieces.groupBy(*block).agg(F.max("record").alias("last"))
    ends = scratch.table(
        last.select(*block, "last", F.coalesce(F.sum("last").over(earlier), F.lit(0)).alias("base")),
        "csv-ends",
    )
    placed = pieces.join(F.broadcast(ends), block).withColumn("number", F.col("base") + F.col("record"))
    inner = (F.col("record") > 0) & (F.col("record") < F.col("last"))
    edges = placed.where(~inner).groupBy(_FILE, "number").agg(_joined(F.struct(_BLOCK, "value")).alias("value"))
    whole = placed.where(inner).select(_FILE, "number", "value").union(edges)
    return whole.select(
        F.col(_FILE).alias("file"),
        "number",
        F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)"))
        .otherwise(F.col("value"))
        .alias("value"),
    )


def _joined(parts: Column) -> Column:
    ordered = F.sort_array(F.collect_list(parts))
    return F.array_join(F.transform(ordered, lambda p: p["value"]), "\n")


def land_csv(spark: SparkSession, source: str, path: str, block_bytes: int | None = None) -> DataFrame:
    """Multi-line CSV files as a parquet table, in many tasks even if it is one file.

    The same rows as `read_csv` gives, which takes one task for each file. The header is that of the
    first file. `block_bytes` is the least size of a block if the session's own is too large; sources
    that would have more than MANY_BLOCKS of them get larger ones, up to the session's own.
    """
    size = "spark.sql.files.maxPartitionBytes"
    given = spark.conf.get(size)
    if block_bytes:
        spark.conf.set(size, str(block_size(spark, source, block_bytes)))
    try:
        with Scratch(spark) as scratch:
            records = scratch.table(split_records(spark, source, scratch), "csv-records")
            names = _header(records)
            schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
            rows = records.where("number > 1 AND value <> ''").select(
                F.from_csv("value", schema, {**_OPTIONS, "multiLine": "true"}).alias("r")
            )
            rows.select(*[null_if_na(F.col("r")[n]).alias(n) for n in names]).write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(size, given)
    return spark.read.parquet(path)


def block_size(spark: SparkSession, source: str, least: int) -> int:
    """Bytes of a block of CSV files, so that their number does not grow with small blocks."""
    own = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(least, min(own, -(-stored_bytes(spark, source) // MANY_BLOCKS)))


def _header(records: DataFrame) -> list[str]:
    first = records.where("number = 1").orderBy("file").limit(1)
    line = first.collect()
    if not line:
        raise ValueError("no header: the files are empty")
    spark = records.sparkSession
    one = spark.createDataFrame([(line[0]["value"],)], "value string")
    width = f"c0 string{''.join(f', c{i} string' for i in range(1, line[0]['value'].count(',') + 1))}"
    row = one.select(F.from_csv("value", width, {**_OPTIONS, "multiLine": "true"}).alias("r")).first()["r"]
    return [name for name in row if name is not None]


def read_labelled_articles(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return require_columns(read_csv(spark, path, multi_line), ARTICLE_COLUMNS)


def read_texts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return require_columns(read_csv(spark, path, multi_line), [TEXT_COLUMN])


def land(df: DataFrame, path: str, id_col: str) -> DataFrame:
    """Write `df` as parquet with a row key, so that later passes are split and keys stay put."""
    if id_col in df.columns:
        raise ValueError(f"column {id_col} exists already")
    df.withColumn(id_col, F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Rows as CSV files with a header; every task writes its own part."""
    df.write.mode("overwrite").csv(
        path,
        header=True,
        quote='"',
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def shape(df: DataFrame) -> DataFrame:
    """Number of rows and columns, one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def preview(df: DataFrame, order_by: str, n: int = 10) -> DataFrame:
    """The first rows by a key, since a distributed table has no order of its own."""
    return df.orderBy(order_by).limit(n)
