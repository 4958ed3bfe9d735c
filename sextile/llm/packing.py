"""Sequences of fixed length from documents, by cutting-stock column generation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .tokens import WordTokens
from .words import slices


# Turns of column generation for each class after which the plan is taken as it is: valid, as what it
# leaves is placed by first fit, though not proven to be near the best.
MOST_TURNS = 50


@dataclass(frozen=True)
class PackParams:
    """Tokens of a sequence, the id that ends a document, and the classes of piece lengths.

    Lengths are rounded up to `grain` tokens for the plan, which has `length / grain` classes.
    """

    length: int = 2048
    end_id: int = 1
    grain: int = 8
    tokenizer: str = "word_bpe_49k.json"
    # Column generation ends when the plan is proven to be within this share of the best.
    gap: float = 1e-3
    # Rows ranked together in one window.
    ranked_rows: int = 50_000


def _pieces(path: str, params: PackParams, with_ids: bool):
    end = np.array([params.end_id], "<u4").tobytes()
    wide = 4 * params.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One a task: tokenizer and remembered words go with it.
        tokens = WordTokens(path)
        for batch in slices(batches):
            out: dict[str, list] = {k: [] for k in _PIECE.names}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens.ids(text.as_py()) + end
                for at in range(0, len(ids), wide):
                    part = ids[at : at + wide]
                    out["doc_id"].append(doc_id)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["doc_tokens"].append(len(ids) // 4)
                    out["ids"].append(part if with_ids else None)
            yield pa.record_batch([pa.array(out[f.name], f.type) for f in _PIECE], schema=_PIECE)
            del out
        pa.default_memory_pool().release_unused()

    return run


_PIECE = pa.schema(
    [(k, pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    + [("ids", pa.binary())]
)


def plan(counts: np.ndarray, gap: float = 1e-3) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, so that all of `counts` are packed.

    `counts[c - 1]` pieces have size `c`, a sequence has room for `len(counts)`. A pattern is an
    array of pieces by class. The linear program over patterns is solved by column generation: a
    knapsack over the shadow prices of the classes gives the pattern to add, until no pattern is
    worth more than a sequence. Whole parts of the solution are used as they are; what they leave
    over, some pieces for each pattern, goes to the first sequence with room, large pieces first.
    """
    room = len(counts)
    classes = np.flatnonzero(counts) + 1
    if not len(classes):
        return []
    need = counts[classes - 1].astype(float)
    patterns = np.diag((room // classes).astype(float))
    cost = np.ones(len(classes))
    inverse = np.diag(1 / np.diag(patterns))
    amount = inverse @ need
    turns = 0
    while True:
        turns += 1
        if turns > MOST_TURNS * len(classes):
            break
        price = cost @ inverse
        if price.min() < -1e-9:
            # More pieces of a class than needed do no harm: places may stay empty.
            column, value = -np.eye(len(classes))[price.argmin()], 0.0
        else:
            column, best = _knapsack(classes, price, room)
            value = 1.0
            if best <= 1 + gap:
                break
        turn = inverse @ column
        ratio = np.where(turn > 1e-9, amount / np.where(turn > 1e-9, turn, 1), np.inf)
        out = int(ratio.argmin())
        patterns[:, out], cost[out] = column, value
        inverse[out] /= turn[out]
        amount[out] /= turn[out]
        others = np.arange(len(classes)) != out
        inverse[others] -= np.outer(turn[others], inverse[out])
        amount[others] -= turn[others] * amount[out]
    used = []
    left = counts.copy().astype(np.int64)
    for i in np.flatnonzero(cost > 0):
        times = int(np.floor(max(amount[i], 0) + 1e-6))
        if times:
            pattern = np.zeros(room, np.int64)
            pattern[classes - 1] = np.rint(patterns[:, i]).astype(np.int64)
            used.append((pattern, times))
            left -= np.minimum(pattern * times, left)
    return used + [(p, 1) for p in _first_fit(left)]


def _knapsack(classes: np.ndarray, price: np.ndarray, room: int) -> tuple[np.ndarray, float]:
    """The pattern of the highest price, by dynamic programming over the room that is filled."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        fits = np.searchsorted(classes, w, side="right")
        best[w] = best[w - 1]
        if fits:
            worth = best[w - classes[:fits]] + price[:fits]
            top = int(worth.argmax())
            if worth[top] > best[w] + 1e-12:
                best[w], last[w] = worth[top], top
    pattern, w = np.zeros(len(classes)), room
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            pattern[last[w]] += 1
            w -= classes[last[w]]
    return pattern, float(best[room])


def _first_fit(left: np.ndarray) -> list[np.ndarray]:
    room = len(left)
    bins: list[np.ndarray] = []
    free: list[int] = []
    for size in range(room, 0, -1):
        n = int(left[size - 1])
        for i in range(len(bins)):
            if not n:
                break
            take = min(n, free[i] // size)
            if take:
                bins[i][size - 1] += take
                free[i] -= take * size
                n -= take
        while n:
            take = min(n, room // size)
            bins.append(np.zeros(room, np.int64))
            bins[-1][size - 1] = take
            free.append(room - take * size)
            n -= take
    return bins


def _places(used: list[tuple[np.ndarray, int]]):
    """For each class, from which rank on which sequences take how many pieces each."""
    places: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for pattern, times in used:
        for c in np.flatnonzero(pattern) + 1:
            each = int(pattern[c - 1])
            at = ranks.get(int(c), 0)
            places.setdefault(int(c), []).append((at, base, each))
            ranks[int(c)] = at + each * times
        base += times
    return {c: np.array(v, np.int64) for c, v in places.items()}


def pack(
    docs: DataFrame,
    scratch: Scratch,
    params: PackParams = PackParams(),
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document and where it goes.

    Columns: `doc_id`, `start` (the document's ids before it), `length`, `ids_crc32`, `doc_tokens`,
    `ids` (unsigned little-endian 32-bit ids, null without `with_ids`), `sequence_id` and `offset`
    there. A document's ids end with `end_id`; a null or empty text has that one id. Documents longer
    than a sequence are cut into full sequences and a rest. Repeated rows are packed each, rows
    without an id are left out; other columns are not read; no rows give no rows.

    Only the histogram of lengths reaches the driver. Each class is ranked in windows of bounded
    size, whose offsets come from their counts, and a rank gives the sequence without a join.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(
        "doc_id is not null"
    )
    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    )
    run = _pieces(public_tokenizers.path(params.tokenizer), params, with_ids)
    made = texts.mapInArrow(run, schema).withColumn("piece", F.monotonically_increasing_id())
    pieces = scratch.table(made, "pieces")
    classes = -(-params.length // params.grain)
    classed = pieces.drop("ids").withColumn("class", F.ceil(F.col("length") / params.grain).cast("int"))
    counts = np.zeros(classes, np.int64)
    for row in classed.groupBy("class").count().collect():
        counts[row["class"] - 1] = row["count"]
    places = _places(plan(counts, params.gap))

    @F.arrow_udf("long")
    def sequence(size: pa.Array, rank: pa.Array) -> pa.Array:
        size, rank = size.to_numpy(), rank.to_numpy()
        out = np.zeros(len(size), np.int64)
        for c in np.unique(size).tolist():
            at = np.flatnonzero(size == c)
            r = rank[at]
            row = places[c][np.searchsorted(places[c][:, 0], r, side="right") - 1]
            out[at] = row[:, 1] + (r - row[:, 0]) // row[:, 2]
        return pa.array(out)

    windows = max(1, -(-int(counts.sum()) // params.ranked_rows))
    dealt = classed.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(windows)))
    before = (
        dealt.groupBy("class", "part").count()
        .withColumn(
            "before",
            F.sum("count").over(Window.partitionBy("class").orderBy("part")) - F.col("count"),
        )
        .drop("count")
    )
    within = Window.partitionBy("class", "part").orderBy("doc_id", "start", "piece")
    ranked = dealt.withColumn("within", F.row_number().over(within) - 1).join(
        before, ["class", "part"]
    )
    placed = ranked.withColumn(
        "sequence_id", sequence("class", F.col("before") + F.col("within"))
    )
    # Pieces of repeated rows differ by their number alone, and each has a place of its own.
    filled = (
        Window.partitionBy("sequence_id")
        .orderBy(F.desc("length"), "doc_id", "start", "piece")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = placed.withColumn("offset", F.sum("length").over(filled) - F.col("length"))
    # The ids are moved once, when their places are known.
    ids = pieces.select("piece", "ids")
    placed = placed.join(ids, "piece") if with_ids else placed.withColumn("ids", F.lit(None))
    return placed.withColumn("ids", F.col("ids").cast("binary")).select(
        *_PIECE.names, "sequence_id", "offset"
    )


def sequences(pieces: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """`sequence_id`, `n_tokens` and `ids` of every whole sequence, padded with zeros.

    A sequence whose tokens are a power of two is not padded. `pieces` must have their ids.
    """
    return (
        pieces.groupBy("sequence_id")
        .agg(
            F.sum("length").alias("n_tokens"),
            F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"),
        )
        .select(
            "sequence_id",
            "n_tokens",
            F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"),
        )
        .select(
            "sequence_id",
            "n_tokens",
            F.when(F.expr("(n_tokens & (n_tokens - 1)) = 0"), F.col("ids"))
            .otherwise(F.expr(f"rpad(ids, {4 * params.length}, X'00')"))
            .alias("ids"),
        )
    )
