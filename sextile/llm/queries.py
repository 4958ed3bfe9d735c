"""The operators as registered queries over whole given tables."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Scratch, materialize
from . import decontaminate, exact, html, langid, licences, lines, near, negatives, packing, pii, repeats
from . import search, warc

# Which documents a language model may be learned from.
HELD_OUT = "crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2"

_sent: dict[str, str] = {}


def send_code(spark: SparkSession) -> None:
    """Give executors this package, wherever they run; once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        package = Path(__file__).resolve().parents[1]
        base = f"{tempfile.mkdtemp(prefix='sextile-code-')}/{package.name}"
        _sent[app] = shutil.make_archive(base, "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(_sent[app])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(spark: SparkSession, name: str, build: Callable[[Scratch], DataFrame]) -> DataFrame:
    """A result written to the shared folder, so that the tables it was made from can go."""
    send_code(spark)
    with Scratch(spark) as scratch:
        return materialize(build(scratch), name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    docs = table(spark, sf_dir, "documents")
    return settled(
        spark, "packed", lambda s: packing.pack(docs, s, with_ids=False).drop("ids")
    )


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without passages of an earlier one."""
    docs = table(spark, sf_dir, "documents")
    return settled(spark, "kept", lambda s: repeats.remove_repeats(docs, s, digest=True))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences and licence notices among the documents' texts and lines."""
    return licences.scan_licences(table(spark, sf_dir, "documents"), licences.catalogue(spark))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back through the merged index."""
    pages = table(spark, sf_dir, "pages")

    def build(scratch: Scratch) -> DataFrame:
        path = scratch.path("archives")
        warc.write_archives(pages, path, scratch)
        index = warc.capture_index(spark, path, scratch)
        return index.select(
            "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
        )

    return settled(spark, "captures", build)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and digest of base spans, and all spans."""
    docs = table(spark, sf_dir, "documents")

    def build(scratch: Scratch) -> DataFrame:
        found = pii.find(docs, pii.learn(docs, scratch))
        counts = [
            F.size(F.expr(f"filter(base, s -> s.kind = '{kind}')")).cast("long").alias(f"n_{kind}")
            for kind in pii.KINDS
        ]
        return found.select(
            "doc_id",
            *counts,
            F.sha2(_spelled("base"), 256).alias("base_sha256"),
            _spelled(F.concat("base", "added")).alias("spans"),
            F.size(F.expr("filter(added, s -> s.kind = 'secret')")).cast("long").alias("n_secret"),
        )

    return settled(spark, "private", build)


def _spelled(spans) -> F.Column:
    """kind:start:end by start and kind, joined by commas."""
    kinds = F.array(*map(F.lit, pii.ALL_KINDS))
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"], F.array_position(kinds, s["kind"]), s["end"], s["kind"])
    )
    text = F.transform(
        F.sort_array(keyed),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(text, ",")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    send_code(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    weights = html.learn(pages)
    return html.extract(pages, weights)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out."""
    send_code(spark)
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(f"NOT ({HELD_OUT})"))
    return langid.identify(docs, profiles).selectExpr(
        "doc_id", f"({HELD_OUT}) AS held_out", "lang_pred", "score"
    )


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a copy or an edited copy of a benchmark item, and where it stands."""
    send_code(spark)
    return decontaminate.leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the one that stays of each group of equal texts."""
    docs = table(spark, sf_dir, "documents")

    def build(scratch: Scratch) -> DataFrame:
        groups = exact.exact_groups(docs, scratch)
        digests = exact.digests(docs).select(
            "doc_id", F.lower(F.hex("sha256")).alias("text_sha256")
        )
        return groups.join(digests, "doc_id").select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id") == F.col("keep_id")).alias("kept"),
            "text_sha256",
        )

    return settled(spark, "copies", build)


def op10_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their class of near duplicates."""
    docs = table(spark, sf_dir, "documents")
    params = near.NearParams(shingle=3, percent=85)
    return settled(
        spark,
        "classes",
        lambda s: near.near_duplicates(docs, s, params).withColumn(
            "kept", F.col("doc_id") == F.col("component_id")
        ),
    )


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return settled(spark, "ranked", lambda s: search.search(docs, items, s))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the lines that ten documents share."""
    docs = table(spark, sf_dir, "documents")

    def build(scratch: Scratch) -> DataFrame:
        bitmaps = scratch.table(lines.line_bitmaps(docs, scratch), "bitmaps")
        return lines.kept_lines(docs, bitmaps, digest=True)

    return settled(spark, "kept-lines", build)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; some labels are shifted by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    anchor = F.col("vec_id") % 50 == 0
    return settled(spark, "negatives", lambda s: negatives.mine(rows, anchor, s))


ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_repeats,
        op3_licences,
        op4_warc,
        op5_pii,
        op6_main_text,
        op7_language,
        op8_leaks,
        op9_exact,
        op10_near,
        op11_search,
        op12_lines,
        op13_negatives,
    )
}
