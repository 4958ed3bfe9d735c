"""Joins of a large table with a table that has one row for each key, for keys that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The small side is broadcast if it was counted and has no more rows of a few numbers than this.
BROADCAST_ROWS = 200_000
# Beyond that, the rows of a key are dealt to so many tasks.
SALTS = 16


def join_keys(
    rows: DataFrame, keys: DataFrame, on: list[str], how: str, spread: str = "doc_id"
) -> DataFrame:
    """`rows` joined with `keys`, a written table with one row for each key `on`.

    A key may have a third of `rows`. If the keys are few they are broadcast and nothing moves; else
    every key is repeated for each salt, so that its rows, dealt by `spread`, go to many tasks.
    """
    if keys.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    every = keys.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return salted.join(every, [*on, "_salt"], how).drop("_salt")
