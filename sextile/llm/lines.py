"""Lines that many documents share, found in range-partitioned line hashes; bitmaps instead of texts."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .words import slices

# Fixed value: the characters that are stripped from the ends of a line.
BLANKS = " \t\n\x0b\x0c\r"

# What the pass over the sorted hashes says of a row: its line goes; undecided, as its line has too few
# documents in this partition and may go on in a neighbour; first row of a line of enough documents
# that may go on in a neighbour.
_GOES, _OPEN, _HEAD = 0, 1, 2


@dataclass(frozen=True)
class LineParams:
    """Which lines go: those of at least `least_chars` characters in at least `least_docs` documents.

    With `keep_first` the first occurrence, by document and position, stays. A row of the hash table
    holds `row_lines` lines at most.
    """

    least_docs: int = 10
    least_chars: int = 1
    keep_first: bool = False
    row_lines: int = 1 << 16


def _hashed(params: LineParams):
    """Rows of (doc_id, text_id, n_lines) with hashes and positions of the lines that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            split = pc.split_pattern(texts, "\n")
            keys = pc.ascii_lower(pc.ascii_trim(split.flatten(), characters=BLANKS))
            begin = split.offsets.to_numpy().astype(np.int64)
            begin = begin - begin[0]
            n_lines = np.diff(begin)
            position = np.arange(begin[-1]) - np.repeat(begin[:-1], n_lines)
            counts = pc.utf8_length(keys).to_numpy(zero_copy_only=False) >= params.least_chars
            used = np.concatenate([[0], np.cumsum(counts)])[begin]
            digests = [
                xxhash.xxh3_128_digest(k)
                for k in keys.filter(pa.array(counts)).cast(pa.large_binary()).to_pylist()
            ]
            hashes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            position = position[counts]
            rows, at = [], [0]
            for i, (a, b) in enumerate(zip(used, used[1:])):
                for low in range(a, max(b, a + 1), params.row_lines):
                    rows.append(i)
                    at.append(min(low + params.row_lines, b))
            rows, at = np.array(rows), np.array(at, np.int32)
            yield pa.record_batch(
                [
                    batch.column("doc_id").take(pa.array(rows)),
                    batch.column("text_id").take(pa.array(rows)),
                    pa.array(n_lines[rows], pa.int64()),
                    pa.ListArray.from_arrays(at, pa.array(hashes[:, 0])),
                    pa.ListArray.from_arrays(at, pa.array(hashes[:, 1])),
                    pa.ListArray.from_arrays(at, pa.array(position, pa.int64())),
                ],
                names=["doc_id", "text_id", "n_lines", "h1", "h2", "pos"],
            )

    return run


def _streamed(params: LineParams):
    """Over rows (h1, h2, doc_id, text_id, pos) in order: those whose lines go, and the edges.

    Rows of a line are held until it has enough documents, from then on they pass through, so fewer
    than `least_docs` documents' rows are held. Only the first and the last line of a partition can
    have rows in a neighbour; what is known of them is passed on for `_settled`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), np.int64)  # of the last line, while it has too few documents
        head = None  # the first row of the last line, once it has enough
        edge = True  # no line has ended in this partition yet
        previous = np.zeros((0, 5), np.int64)
        for batch in batches:
            rows = np.column_stack([c.to_numpy() for c in batch.columns])
            # Places of repeated rows follow each other, in one partition.
            pairs = np.concatenate([previous, rows])
            again = np.zeros(len(rows), bool)
            again[1 - len(previous) :] = (pairs[1:] == pairs[:-1]).all(axis=1)
            rows = rows[~again]
            if not len(rows):
                continue
            previous = rows[-1:]
            rows = np.concatenate([held, rows])
            out: list[tuple[np.ndarray, int]] = []

            def ended(head: np.ndarray, edge: bool) -> None:
                if edge or not params.keep_first:
                    out.append((head[None, :], _HEAD if edge else _GOES))

            goes_on = head is not None and (rows[0, :2] == head[:2]).all()
            if head is not None and not goes_on:
                ended(head, edge)
                head, edge = None, False
            change = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            start = np.concatenate([[0], np.flatnonzero(change) + 1])
            line = np.concatenate([[0], np.cumsum(change)])
            other = np.concatenate([[True], change | (rows[1:, 2] != rows[:-1, 2])])
            many = np.bincount(line, other) >= params.least_docs
            many[0] |= goes_on
            first = np.zeros(len(rows), bool)
            first[start] = True
            first[0] &= not goes_on
            out.append((rows[many[line] & ~first], _GOES))
            if len(start) > 1:
                if many[0]:
                    ended(head if goes_on else rows[0], edge)
                elif edge:
                    out.append((rows[: start[1]], _OPEN))
                if not params.keep_first:
                    out.append((rows[start[1:-1][many[1:-1]]], _GOES))
                head, edge, goes_on = None, False, False
            last = rows[start[-1] :]
            if many[-1]:
                head, held = (head if goes_on else last[0].copy()), rows[:0]
            else:
                held = last.copy()
            yield from _marked(out)
        if head is not None:
            yield from _marked([(head[None, :], _HEAD)])
        yield from _marked([(held, _OPEN)])

    return run


def _marked(parts: list[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    for rows, state in parts:
        if len(rows):
            columns = [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(5)]
            columns.append(pa.array(np.full(len(rows), state, np.int32)))
            yield pa.record_batch(columns, names=["h1", "h2", "doc_id", "text_id", "pos", "state"])


def _settled(found: DataFrame, params: LineParams) -> DataFrame:
    """Places of all lines that go, once the edges of neighbouring partitions are put together.

    An edge has the rows of fewer than `least_docs` documents or a single row, so these are a few
    rows for each partition, however frequent a line is.
    """
    edges = found.where(f"state <> {_GOES}")
    lines = edges.groupBy("h1", "h2").agg(
        F.max(F.col("state") == _HEAD).alias("enough"),
        F.count_distinct("doc_id").alias("n_docs"),
        F.min(F.struct("doc_id", "text_id", "pos")).alias("first"),
    )
    gone = edges.join(lines, ["h1", "h2"]).where(f"enough OR n_docs >= {params.least_docs}")
    if params.keep_first:
        gone = gone.where(F.struct("doc_id", "text_id", "pos") != F.col("first"))
    place = ["doc_id", "text_id", "pos"]
    return found.where(f"state = {_GOES}").select(*place).union(gone.select(*place))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_dropped, keep = [], []
        for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone")):
            bits = np.ones(n, bool)
            if gone.is_valid:
                bits[gone.values.to_numpy()] = False
            n_dropped.append(n - int(bits.sum()))
            keep.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
        yield pa.record_batch(
            [*batch.columns[:3], pa.array(n_dropped, pa.int64()), pa.array(keep, pa.binary())],
            names=["doc_id", "text_id", "n_lines", "n_dropped", "keep"],
        )


def line_bitmaps(
    docs: DataFrame,
    scratch: Scratch,
    params: LineParams = LineParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: `doc_id`, `text_id`, `n_lines`, `n_dropped` and `keep`.

    Lines are what stands between line feeds; a null or empty text is one empty line. Two lines are the
    same if they are once blanks are stripped from their ends and A-Z are lower-cased. `keep` is the
    zlib-compressed bitmap (first line in the lowest bit) of the lines that stay. Repeated rows count
    once and have one bitmap; unlike texts under one id are told apart by `text_id` (`xxhash64`), and
    count as one document. Rows without an id are left out, other columns are not read, no rows give
    no rows.

    Hashes (128 bits) are dealt out in ranges of hash, document and position, so a line that stands in a
    third of all documents is spread over many tasks, each sorts its range, and one pass over it
    tells which lines go. Positions come back by document and become its bitmap; no text is moved.
    """
    hashed = scratch.table(
        _texts(docs, id_col, text_col).mapInArrow(
            _hashed(params),
            "doc_id long, text_id long, n_lines long, h1 array<long>, h2 array<long>, pos array<long>",
        ),
        "line-hashes",
    )
    each = hashed.select("doc_id", "text_id", F.inline(F.arrays_zip("h1", "h2", "pos")))
    order = ["h1", "h2", "doc_id", "text_id", "pos"]
    found = scratch.table(
        each.select(*order)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(
            _streamed(params),
            "h1 long, h2 long, doc_id long, text_id long, pos long, state int",
        ),
        "lines-found",
    )
    # A set, so that repeated rows add nothing on the map side.
    gone = _settled(found, params).groupBy("doc_id", "text_id").agg(F.collect_set("pos").alias("gone"))
    counted = hashed.select("doc_id", "text_id", "n_lines").distinct()
    return (
        counted.join(gone, ["doc_id", "text_id"], "left")
        .select("doc_id", "text_id", "n_lines", "gone")
        .mapInArrow(
            _bitmaps, "doc_id long, text_id long, n_lines long, n_dropped long, keep binary"
        )
    )


def kept_bits(keep: bytes, n_lines: int) -> np.ndarray:
    """A compressed bitmap as one boolean for each line."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    return bits[:n_lines].astype(bool)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for text, n, gone, keep in zip(*(batch.column(c) for c in ("text", "n_lines", "n_dropped", "keep"))):
            text = text.as_py() or ""
            if gone.as_py():
                bits = kept_bits(keep.as_py(), n.as_py())
                text = "\n".join([line for line, bit in zip(text.split("\n"), bits) if bit])
            out.append(text)
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("n_lines"), batch.column("n_dropped"), pa.array(out, pa.large_string())],
            names=["doc_id", "n_lines", "n_dropped", "kept_text"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _applied(batches):
        sha = [hashlib.sha256(x.as_py().encode()).hexdigest() for x in batch.column(3)]
        yield pa.record_batch(
            [*batch.columns[:3], pa.array(sha)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"]
        )


def kept_lines(
    docs: DataFrame,
    bitmaps: DataFrame,
    digest: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`docs` under their bitmaps: `doc_id`, `n_lines`, `n_dropped`, `kept_text` or its `kept_sha256`.

    One row for every row with an id, repeated ones too. Give bitmaps that were written to a table:
    Spark then knows their size, and moves no text as long as they are small enough to broadcast.
    """
    rows = _texts(docs, id_col, text_col).join(bitmaps, ["doc_id", "text_id"])
    rows = rows.select("doc_id", "text", "n_lines", "n_dropped", "keep")
    schema = "doc_id long, n_lines long, n_dropped long, "
    if digest:
        return rows.mapInArrow(_digests, schema + "kept_sha256 string")
    return rows.mapInArrow(_applied, schema + "kept_text string")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.where("doc_id is not null")
    return texts.withColumn("text_id", F.xxhash64(F.coalesce("text", F.lit(""))))
