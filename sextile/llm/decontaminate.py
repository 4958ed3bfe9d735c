"""Training passages that copy or edit benchmark items: rare seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, mix, sequences, slices


# Words by which edits may move two seeds of one copy against each other.
NEAR = 4


@dataclass(frozen=True)
class LeakParams:
    """Seeds, scores of the alignment, and what counts as a leak.

    An alignment is a leak if its score is worth `least_words` matching words, however long the item
    is. A smaller one is a leak if it has the `share` of the item's best score and chance makes its words
    occur together at `chance` of all places at most, or at `whole_chance` if it is the whole item.
    """

    seed_words: int = 3
    # A seed is rare if chance makes it begin at this share of all words at most. An item has its
    # `least_seeds` rarest ones in any case.
    rare: float = 1e-7
    least_seeds: int = 12
    match: int = 2
    mismatch: int = 1
    gap: int = 1
    share: float = 0.5
    least_words: int = 13
    chance: float = 1e-10
    whole_chance: float = 1e-8
    # Seeds with gaps, for copies in which every third, or every second, word is another. They are used
    # wherever chance makes them begin at `spaced_rare` of all words at most.
    spaced: tuple[tuple[int, ...], ...] = ((0, 1, 3), (0, 2, 3), (0, 2, 4))
    spaced_rare: float = 1e-6
    # Every run of so many words of an item has a seed, rare or not.
    window_words: int = 8
    # Text of the benchmark items that are looked for in one pass over the documents.
    block_bytes: int = 8 << 20


@dataclass(frozen=True)
class _Seeds:
    """Seed hashes in order, and the item and place of each."""

    key: np.ndarray
    item: np.ndarray
    place: np.ndarray
    words: list[np.ndarray]
    ids: list
    # The logarithm of each word's share of all words, item by item.
    chance: list[np.ndarray]


def _counted(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(vocabulary), np.int64), 0
        for batch in slices(batches):
            hashes = Words(batch.column(0), lower=True).hashes()
            seen += len(hashes)
            slot = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            total += np.bincount(slot[vocabulary[slot] == hashes], minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.record_batch(
            [pa.array([-1, *some.tolist()], pa.int64()), pa.array([seen, *total[some].tolist()], pa.int64())],
            ["word", "n"],
        )

    return run


def _rare_seeds(texts: DataFrame, items: list, p: LeakParams) -> _Seeds | None:
    """Seeds by the chance of their words in the whole corpus, not by how often they occur there.

    So a passage stays findable however many documents copy it.
    """
    words = Words(pa.array([x["text"] for x in items], pa.string()), lower=True)
    hashes = words.hashes()
    if not len(hashes):
        return None
    vocabulary = np.unique(hashes)
    counts = np.zeros(len(vocabulary))
    total = 1
    found = texts.select("text").mapInArrow(_counted(vocabulary), "word long, n long")
    for row in found.groupBy("word").agg(F.sum("n").alias("n")).collect():
        if row["word"] < 0:
            total = max(1, row["n"])
        else:
            counts[row["word"]] = row["n"]
    chance = np.log(np.maximum(counts, 1) / total)[np.searchsorted(vocabulary, hashes)]
    key, item, place, listed, ids, chances = [], [], [], [], [], []
    for i, row in enumerate(items):
        own = hashes[words.first[i] : words.first[i + 1]]
        k = min(p.seed_words, len(own))
        if not k:
            continue
        own_chance = chance[words.first[i] : words.first[i + 1]]
        likely = np.convolve(own_chance, np.ones(k), "valid")
        order = np.argsort(likely, kind="stable")
        for number, shape in enumerate(p.spaced, 1):
            if len(own) > shape[-1]:
                at = np.flatnonzero(_spread(own_chance, shape).sum(axis=0) <= np.log(p.spaced_rare))
                key.append(_spaced(own, shape, number)[at])
                place.append(at)
                item.append(np.full(len(at), len(ids)))
        use = order[(np.arange(len(order)) < p.least_seeds) | (likely[order] <= np.log(p.rare))]
        use = np.union1d(use, _rarest(likely, p.window_words - k + 1))
        key.append(sequences(own, k)[use])
        place.append(use)
        item.append(np.full(len(use), len(ids)))
        listed.append(own)
        chances.append(own_chance)
        ids.append(row["item_id"])
    if not ids:
        return None
    key, item, place = map(np.concatenate, (key, item, place))
    order = np.argsort(key, kind="stable")
    return _Seeds(key[order], item[order], place[order], listed, ids, chances)


def _spread(values: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """The values under a shape, one row for each of its words, one column for each place."""
    n = max(0, len(values) - shape[-1])
    return np.array([values[o : o + n] for o in shape])


def _spaced(hashes: np.ndarray, shape: tuple[int, ...], number: int) -> np.ndarray:
    """A hash of the words under a shape at every place; unlike shapes have unlike hashes."""
    first, *others = _spread(hashes, shape)
    out = first + np.uint64(number)
    for row in others:
        out = out * np.uint64(0x9E3779B97F4A7C15) + row
    return mix(out)


def _rarest(likely: np.ndarray, window: int) -> np.ndarray:
    """The place of the smallest value of each window, the first of equal ones."""
    if len(likely) <= window:
        return np.array([likely.argmin()])
    windows = np.lib.stride_tricks.sliding_window_view(likely, window)
    return np.unique(windows.argmin(axis=1) + np.arange(len(windows)))


def _improbable(query: np.ndarray, chance: np.ndarray, stretch: np.ndarray) -> float:
    """The logarithm of the chance of the query's words that the stretch has, each as often at most."""
    left = Counter(stretch.tolist())
    total = 0.0
    for word, log in zip(query.tolist(), chance.tolist()):
        if left[word] > 0:
            left[word] -= 1
            total += log
    return total


def _is_leak(score: int, query: np.ndarray, chance: np.ndarray, stretch: np.ndarray, p: LeakParams):
    full = p.match * len(query)
    if score >= p.match * p.least_words:
        return True
    if score < p.share * full:
        return False
    return _improbable(query, chance, stretch) <= np.log(p.whole_chance if score == full else p.chance)


def align(item: np.ndarray, region: np.ndarray, p: LeakParams = LeakParams()) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, and its first and last + 1 word of `region`.

    Rows are filled at once: a gap along the row is a running maximum.
    """
    n = len(region)
    steps = np.arange(n + 1) * p.gap
    above, above_from = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = above[:-1] + np.where(region == word, p.match, -p.mismatch)
        here = np.zeros(n + 1, np.int64)
        begin = np.arange(n + 1)
        up = above[1:] - p.gap
        here[1:] = np.maximum(np.maximum(diagonal, up), 0)
        begin[1:] = np.where(
            here[1:] <= 0, begin[1:], np.where(diagonal >= up, above_from[:-1], above_from[1:])
        )
        lifted = here + steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        along = top - steps
        begin = np.where(along > here, begin[source], begin)
        above, above_from = np.maximum(here, along), begin
        j = int(above.argmax())
        if above[j] > best[0]:
            best = (int(above[j]), int(above_from[j]), j)
    return best


def _regions(starts: np.ndarray, length: int, n_words: int) -> Iterator[tuple[int, int]]:
    """Stretches around the places at which the seeds say that an item may begin."""
    starts = np.sort(starts)
    cuts = np.flatnonzero(np.diff(starts) > length) + 1
    for part in np.split(starts, cuts):
        yield max(0, int(part[0]) - length), min(n_words, int(part[-1]) + 2 * length)


def _places(
    seeds: _Seeds, looks: list, text: np.ndarray, first: np.ndarray
) -> Iterator[tuple[int, int, np.ndarray]]:
    """Texts and items that share seeds, and the words of the text at which the item may begin.

    A seed with gaps counts for nothing by itself: without a seed of consecutive words there must be two of
    them which say, but for NEAR words, that the item begins at the same place.
    """
    found = []
    for grams, at, has_gaps in looks:
        low = np.searchsorted(seeds.key, grams[at], "left")
        n = np.searchsorted(seeds.key, grams[at], "right") - low
        seed = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        word = np.repeat(at, n)
        doc = text[word]
        start = word - seeds.place[seed] - first[doc]
        found.append(np.array([doc, seeds.item[seed], start, np.full(len(doc), has_gaps)], np.int64))
    doc, item, start, has_gaps = np.concatenate(found, axis=1)
    order = np.lexsort((start, item, doc))
    doc, item, start, has_gaps = doc[order], item[order], start[order], has_gaps[order]
    if not len(doc):
        return
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
    close = np.concatenate([[False], ~new[1:] & (np.diff(start) <= NEAR)])
    begin = np.flatnonzero(new)
    good = np.add.reduceat((has_gaps == 0) | close, begin) > 0
    for a, b in zip(begin[good].tolist(), np.append(begin[1:], len(doc))[good].tolist()):
        yield int(doc[a]), int(item[a]), start[a:b]


def _leak_rows(seeds: _Seeds, p: LeakParams):
    sizes = sorted({min(p.seed_words, len(x)) for x in seeds.words})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column(1), lower=True)
            hashes = words.hashes()
            text = words.owner()
            looks = [(sequences(hashes, k), words.runs(k), False) for k in sizes]
            looks += [
                (_spaced(hashes, shape, i), words.runs(shape[-1] + 1), True)
                for i, shape in enumerate(p.spaced, 1)
            ]
            places = _places(seeds, looks, text, words.first)
            out = {k: [] for k in _LEAK.names}
            for doc, item, starts in places:
                own = hashes[words.first[doc] : words.first[doc + 1]]
                query = seeds.words[item]
                best = (0, 0, 0)
                for a, b in _regions(starts, len(query), len(own)):
                    score, x, y = align(query, own[a:b], p)
                    best = max(best, (score, a + x, a + y), key=lambda z: z[0])
                share = best[0] / (p.match * len(query))
                stretch = own[best[1] : best[2]]
                if _is_leak(best[0], query, seeds.chance[item], stretch, p):
                    row = (batch.column(0)[doc].as_py(), seeds.ids[item], share, best[1], best[2])
                    for name, value in zip(_LEAK.names, row):
                        out[name].append(value)
            yield pa.record_batch([pa.array(out[f.name], f.type) for f in _LEAK], schema=_LEAK)

    return run


_LEAK = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())]
    + [("start_word", pa.int64()), ("end_word", pa.int64())]
)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    params: LeakParams = LeakParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document and benchmark item whose alignment is long enough, or most of the item.

    Columns: `doc_id`, `item_id`, `score` (share of the best possible one), and the words of the
    document from `start_word` to before `end_word` that align. An alignment worth 13 matching words
    counts whatever the item's length; a smaller one if it has half of the item's best score, or all of
    it, with words that rarely occur together by chance. A-Z count as a-z. Null or empty texts
    on either side give no rows, nor do items or documents that are missing; equal items are found
    each. Repeated rows count once, rows without an id are left out; other columns are not read.

    The items are the stated query set, in blocks of bounded size by id; each block is sent to all
    documents. A first pass counts the items' own words in the whole corpus, and an item's seeds are
    the runs of words that are least likely by those counts, with one in any eight words, so that
    no part of a long item is without, and words with gaps between them that are unlikely enough.
    The alignment is limited to stretches around seeds and looks at every one of them. A copy in which
    no seed is left whole is not found: one that has only common words, or in which fewer than two
    shapes of three of the item's words are left.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(
        "doc_id is not null"
    )
    items = items.select("item_id", "text").where("item_id is not null").distinct()
    volume = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-volume // params.block_bytes))
    parts = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        seeds = _rare_seeds(texts, own.orderBy("item_id", "text").collect(), params)
        if seeds:
            parts.append(
                texts.mapInArrow(
                    _leak_rows(seeds, params),
                    "doc_id long, item_id long, score double, start_word long, end_word long",
                )
            )
    if not parts:
        return texts.limit(0).selectExpr(
            "doc_id", "0L item_id", "0D score", "0L start_word", "0L end_word"
        )
    return reduce(DataFrame.union, parts).distinct()
