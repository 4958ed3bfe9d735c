"""Ranked lexical search by accumulator-limited term-at-a-time evaluation over blocks of documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .words import Words, slices

# Bytes of words: digits, letters and all of a code point beyond ASCII. The others become blanks.
_TERM = np.full(256, 0x20, np.uint8)
for _bytes in (range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100)):
    _TERM[_bytes] = _bytes


@dataclass(frozen=True)
class SearchParams:
    """Results of an item, and how much is worked on at a time.

    Items are searched in blocks of `item_bytes` of text, which tasks hold as a whole. A task ranks
    its documents in blocks of `block_docs` documents and some `block_postings` postings.
    """

    top: int = 20
    item_bytes: int = 8 << 20
    block_docs: int = 1 << 15
    block_postings: int = 1 << 21


def terms_of(texts: pa.Array) -> Words:
    """The terms of texts as words: runs of letters and digits of ASCII and of all beyond it."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return Words(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    begin, end = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[begin:end] if end else np.zeros(0, np.uint8)
    buffers = [None, pa.py_buffer(offsets - begin), pa.py_buffer(_TERM[raw])]
    return Words(pa.Array.from_buffers(pa.large_string(), len(texts), buffers), lower=True)


@dataclass(frozen=True)
class _Queries:
    """Items of a block: their ids, all their terms' hashes in order, and each item's terms."""

    ids: list[int]
    vocabulary: np.ndarray
    terms: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list[int], texts: list[str | None]) -> _Queries:
        words = terms_of(pa.array(texts, pa.large_string()))
        vocabulary, number = np.unique(words.hashes(), return_inverse=True)
        each = [
            np.unique(number[a:b], return_counts=True) for a, b in zip(words.first, words.first[1:])
        ]
        return cls(ids, vocabulary, each)


def _postings(vocabulary: np.ndarray):
    """For each document its number of terms, and which of the vocabulary it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = terms_of(batch.column("text"))
            hashes = words.hashes()
            at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            hit = vocabulary[at] == hashes
            owner = words.owner()[hit]
            pair, tf = np.unique(owner * len(vocabulary) + at[hit], return_counts=True)
            owner, term = pair // len(vocabulary), pair % len(vocabulary)
            offsets = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(words.first).astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return run


class _Top:
    """The best documents of an item so far."""

    def __init__(self, k: int):
        self._k = k
        self.doc = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a further document must reach: ties may still win by their id."""
        return int(self.score[-1]) if len(self.score) == self._k else 1

    def add(self, doc: np.ndarray, score: np.ndarray) -> None:
        doc, score = np.concatenate([self.doc, doc]), np.concatenate([self.score, score])
        best = np.lexsort((doc, -score))[: self._k]
        self.doc, self.score = doc[best], score[best]


@dataclass(frozen=True)
class Weights:
    """What scoring needs of the whole collection: its sizes and each query term's frequency."""

    n_docs: int
    n_terms: int
    df: np.ndarray

    @property
    def idf(self) -> np.ndarray:
        return np.array(
            [math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * n + 1))) for n in self.df.tolist()],
            np.int64,
        )

    def norm(self, n: np.ndarray) -> np.ndarray:
        return 75 + (25 * n * self.n_docs) // max(self.n_terms, 1)


def search_block(
    doc: np.ndarray,
    n: np.ndarray,
    term: np.ndarray,
    owner: np.ndarray,
    tf: np.ndarray,
    queries: _Queries,
    weights: Weights,
    tops: list[_Top],
    k: int,
) -> int:
    """Adds the documents of a block to the best of each item; returns the accumulators made.

    `owner` is the place in `doc` of each posting. An item's terms are taken one after the other, the
    rarest of the collection first. A term makes accumulators for its documents only as long as
    all that this and the later terms could give reaches the least score of the k best, be it the k-th
    partial score here or the k-th score of earlier blocks; after that, terms update the accumulators
    there are. So every document that can be among the best has its exact score.
    """
    order = np.argsort(term, kind="stable")
    term, owner, tf = term[order], owner[order], tf[order].astype(np.int64)
    worth = weights.idf[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * weights.norm(n)[owner]))
    found, begin = np.unique(term, return_index=True)
    end = np.append(begin[1:], len(term))
    most = np.maximum.reduceat(worth, begin) if len(worth) else np.zeros(0, np.int64)
    score = np.zeros(len(doc), np.int64)
    made = 0
    for (terms, repeats), top in zip(queries.terms, tops):
        at = np.minimum(np.searchsorted(found, terms), len(found) - 1) if len(found) else terms[:0]
        here = np.flatnonzero(found[at] == terms[: len(at)])
        here = here[np.lexsort((terms[here], weights.df[terms[here]]))]
        at, times = at[here], repeats[here]
        bound = np.cumsum((most[at] * times)[::-1])[::-1]
        open_ = True
        touched = []
        for i, j in enumerate(at):
            docs, gain = owner[begin[j] : end[j]], worth[begin[j] : end[j]] * times[i]
            if open_:
                least = top.least
                if bound[i] >= least and i and len(doc) >= k:
                    # The k-th partial score is at most the largest one, which is cheap to look up.
                    if bound[i] < max(int(score[t].max(initial=0)) for t in touched):
                        least = max(least, int(np.partition(score, -k)[-k]))
                open_ = bound[i] >= least
            if not open_:
                live = score[docs] > 0
                docs, gain = docs[live], gain[live]
            else:
                touched.append(docs)
            score[docs] += gain
        if touched:
            reached = np.unique(np.concatenate(touched))
            made += len(reached)
            good = reached[score[reached] >= max(top.least, 1)]
            top.add(doc[good], score[good])
            score[reached] = 0
    return made


def _ranked(queries: _Queries, weights: Weights, params: SearchParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [_Top(params.top) for _ in queries.ids]
        for block in _blocks(batches, params):
            doc, n = (np.concatenate([b.column(c).to_numpy() for b in block]) for c in ("doc_id", "n"))
            lists = [b.column("terms") for b in block]
            size = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists])
            term = np.concatenate([x.flatten().to_numpy() for x in lists])
            tf = np.concatenate([b.column("tfs").flatten().to_numpy() for b in block])
            owner = np.repeat(np.arange(len(doc)), size)
            search_block(doc, n, term, owner, tf, queries, weights, tops, params.top)
        for item, top in zip(queries.ids, tops):
            if len(top.doc):
                yield pa.record_batch(
                    [pa.array([item] * len(top.doc), pa.int64()), pa.array(top.doc), pa.array(top.score)],
                    names=["item_id", "doc_id", "score"],
                )

    return run


def _blocks(batches: Iterator[pa.RecordBatch], params: SearchParams) -> Iterator[list[pa.RecordBatch]]:
    block, docs, postings = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        block.append(batch)
        docs += batch.num_rows
        postings += len(batch.column("terms").flatten())
        if docs >= params.block_docs or postings >= params.block_postings:
            yield block
            block, docs, postings = [], 0, 0
    if block:
        yield block


def search(
    docs: DataFrame,
    items: DataFrame,
    scratch: Scratch,
    params: SearchParams = SearchParams(),
    doc_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """The best documents of each item: `item_id`, `rank` (from 1), `doc_id` and `score`.

    Terms are runs of ASCII letters and digits and of all beyond ASCII, A-Z lower-cased. Scores are
    integers; documents of score 0 have no rank, equal scores are ranked by `doc_id`. Null and empty
    texts have no terms, and an item without terms, or whose terms occur nowhere, has no rows. Every
    row of `docs` with an id is a document, repeated ones too. Of items under one id the one with the
    smallest text counts. Rows without an id are left out, other columns are not read; no documents
    or no items give no rows.

    All documents are read once for each block of items (8 MB of text, so mostly there is one) and
    leave their postings of the items' terms in the shared folder. Sizes and frequencies are counted
    over these. Then every task evaluates all items on its documents, block by block, and only its
    best few of each item are shuffled. Terms are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    chosen = (
        items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
        .where("item_id IS NOT NULL")
        .groupBy("item_id")
        .agg(F.min("text").alias("text"))
    )
    texts = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(
        "doc_id IS NOT NULL"
    )
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // params.item_bytes))
    best = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for i in range(blocks):
        rows = chosen.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()
        queries = _Queries.of([r["item_id"] for r in rows], [r["text"] for r in rows])
        if len(queries.vocabulary):
            best = best.union(_block_best(texts, queries, scratch, params))
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= params.top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _block_best(
    texts: DataFrame, queries: _Queries, scratch: Scratch, params: SearchParams
) -> DataFrame:
    postings = scratch.table(
        texts.mapInArrow(
            _postings(queries.vocabulary), "doc_id long, n long, terms array<int>, tfs array<int>"
        ).where("n > 0"),
        "postings",
    )
    n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(queries.vocabulary), np.int64)
    counts = postings.select(F.explode("terms").alias("term")).groupBy("term").count()
    # A row for each term of the items of this block.
    for row in counts.collect():
        df[row["term"]] = row["count"]
    weights = Weights(n_docs, n_terms or 0, df)
    return postings.where("size(terms) > 0").mapInArrow(
        _ranked(queries, weights, params), "item_id long, doc_id long, score long"
    )
