"""The log and the registry as tables of the catalog, for SQL users and the optimizer.

The tables are external and in place: nothing is copied, and dropping them deletes no file.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from .store import LOG_SCHEMA, REGISTRY_SCHEMA, compact_log, live_partitions

# The partition column that tells writers' folders apart.
PART = "part"
# Partitions that one statement adds or drops.
STATEMENT = 500


def publish_log(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Bring the catalog table of the log at `path` up to date, or make it; returns the table.

    It has the columns of the log and `part`, and is partitioned by `part` and `date`, so a condition
    on the day opens the files of that day alone. Each day of a committed batch, of a compaction and of
    the log's own folder is one partition. What streams wrote is compacted first, since the list of a
    stream's good files is known to its own readers only; so are days of which a compaction has replaced
    some files. Rows that were appended later are seen after the next call, which touches only
    partitions that are new or gone, and takes the sizes of all of them for the optimizer.

    An empty log gives an empty table.
    """
    name = ".".join(map(_name, table.split(".")))
    compact_log(spark, path, always=True)
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"{_name(f.name)} {f.dataType.simpleString()}" for f in LOG_SCHEMA)
        spark.sql(
            f"CREATE TABLE {name} ({columns}, {PART} STRING) USING parquet"
            f" PARTITIONED BY ({PART}, date) LOCATION '{_text(path)}'"
        )
    wanted = {(part, day): where for part, day, where in live_partitions(spark, path)}
    known = {_spec(row[0]) for row in spark.sql(f"SHOW PARTITIONS {name}").collect()}
    gone = [f"PARTITION ({_values(*p)})" for p in sorted(known - set(wanted))]
    new = [
        f"PARTITION ({_values(*p)}) LOCATION '{_text(wanted[p])}'" for p in sorted(set(wanted) - known)
    ]
    # New rows first: between the steps a row may show twice, but none is missing.
    for low in range(0, len(new), STATEMENT):
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {' '.join(new[low : low + STATEMENT])}")
    for low in range(0, len(gone), STATEMENT):
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {', '.join(gone[low : low + STATEMENT])}")
    spark.catalog.refreshTable(table)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS NOSCAN")
    return spark.table(table)


def publish_registry(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The registry at `path` as a catalog table with its row count; new runs show after the next call."""
    name = ".".join(map(_name, table.split(".")))
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"{_name(f.name)} {f.dataType.simpleString()}" for f in REGISTRY_SCHEMA)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet LOCATION '{_text(path)}'")
    spark.catalog.refreshTable(table)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    return spark.table(table)


def _name(part: str) -> str:
    return "`" + part.replace("`", "``") + "`"


def _spec(partition: str) -> tuple[str, date]:
    """part=x/date=2024-01-01, as the catalog lists it."""
    values = dict(item.split("=", 1) for item in partition.split("/"))
    return values[PART], date.fromisoformat(values["date"])


def _values(part: str, day: date) -> str:
    return f"{PART} = '{_text(part)}', date = DATE '{day.isoformat()}'"


def _text(value: str) -> str:
    return value.replace("\\", "\\\\").replace("'", "\\'")
