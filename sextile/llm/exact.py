"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then of all."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .joins import join_keys
from .words import slices

# Bytes of a text that the second step looks at.
PREFIX_BYTES = 512
# Survivors are broadcast (8 bytes each) if they were counted and are no more than this.
BROADCAST_ROWS = 200_000


def normalised(text: str | None) -> bytes:
    """UTF-8 with only A to Z lower-cased; a null text is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
        begin = pc.utf8_slice_codeunits(pc.fill_null(batch.column(1), ""), 0, PREFIX_BYTES)
        prefix = [xxhash.xxh3_64_intdigest(normalised(x)) - (1 << 63) for x in begin.to_pylist()]
        yield pa.record_batch(
            [batch.column(0), size, pa.array(prefix, pa.int64())], ["doc_id", "n_bytes", "prefix"]
        )


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        digest = [hashlib.sha256(normalised(x.as_py())).digest() for x in batch.column(1)]
        yield pa.record_batch(
            [batch.column(0), pa.array(digest, pa.binary())], ["doc_id", "sha256"]
        )


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id` and the SHA-256 of every whole normalised text; repeated rows count once."""
    hashed = _texts(docs, id_col, text_col).mapInArrow(_digested, "doc_id long, sha256 binary")
    return hashed.distinct()


def exact_groups(
    docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: `doc_id`, `keep_id` and `group_size`.

    Texts are equal if they are identical once A to Z are lower-cased; null counts as empty, and
    empty texts are equal to each other. The largest id of a group is kept. Repeated rows count once,
    rows without an id are left out, and an id must not have unlike texts. Other columns of `docs`,
    whatever their names, are not read. No rows give no rows.

    The first pass keeps length and prefix hash only. Lengths that occur once, then pairs of length
    and prefix hash that occur once, settle their documents. The whole text is hashed only for the
    others: they are few and broadcast as ids, or else joined by id. Groups are counted with partial
    sums, and their keys are broadcast or salted (`join_keys`), so a frequent length or text is no
    hot spot.
    """
    texts = _texts(docs, id_col, text_col)
    sizes = scratch.table(
        texts.mapInArrow(_measured, "doc_id long, n_bytes long, prefix long").distinct(), "sizes"
    )
    same_length = _recurring(sizes, ["n_bytes"], scratch)
    left = join_keys(sizes, same_length, ["n_bytes"], "left_semi")
    same_prefix = _recurring(left, ["n_bytes", "prefix"], scratch)
    survivors = scratch.table(
        join_keys(sizes, same_prefix, ["n_bytes", "prefix"], "left_semi"), "survivors"
    )
    few = survivors.count() <= BROADCAST_ROWS
    ids = survivors.select("doc_id")
    left = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    hashed = left.mapInArrow(_digested, "doc_id long, sha256 binary")
    # Texts of unlike length have unlike hashes, so the last step can group by the hash alone.
    full = scratch.table(hashed.distinct(), "full")
    groups = (
        full.groupBy("sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    groups = scratch.table(groups, "groups")
    copies = join_keys(full, groups, ["sha256"], "inner").select("doc_id", "keep_id", "group_size")
    return (
        sizes.select("doc_id")
        .join(copies, "doc_id", "left")
        .select(
            "doc_id",
            F.coalesce("keep_id", "doc_id").alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        )
    )


def _recurring(rows: DataFrame, key: list[str], scratch: Scratch) -> DataFrame:
    """Keys with more than one row."""
    return scratch.table(rows.groupBy(*key).count().where("count > 1").drop("count"), "recurring")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.where("doc_id is not null")
