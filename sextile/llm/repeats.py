"""Passages that recur across documents, found by anchors and located by Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .words import Words, mix, sequences, slices

# Words of the anchor inside a window; of a window's anchors the one of least hash is its own.
ANCHOR = 6


@dataclass(frozen=True)
class RepeatParams:
    """Words of a window, and the sizes by which work is dealt out."""

    window: int = 13
    # Text of a shard of documents, and fingerprints of a bucket, that one task holds.
    shard_bytes: int = 8 << 20
    bucket_rows: int = 1 << 20
    # Words in one automaton; a shard with more has several and goes through each.
    automaton_words: int = 2_000_000


def _shard(ids: np.ndarray, shards: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _windows(words: Words, size: int):
    """Hash of each word, first words of all windows, and the anchor of each of them."""
    hashes = words.hashes()
    grams = sequences(hashes, ANCHOR)
    least, width, reach = grams, 1, size - ANCHOR + 1
    while width < reach:
        step = min(width, reach - width)
        least = np.minimum(least[: len(least) - step], least[step:]) if len(least) > step else least[:0]
        width += step
    at = words.runs(size)
    return hashes, at, least[at]


def _fold(keys: list[np.ndarray], ids: np.ndarray, shards: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each key and shard, only the rows of the smallest and of the largest document."""
    shard = _shard(ids, shards)
    order = np.lexsort((ids, shard, *keys[::-1]))
    keys, ids, shard = [k[order] for k in keys], ids[order], shard[order]
    new = np.ones(len(ids) + 1, bool)
    if len(ids):
        new[1:-1] = shard[1:] != shard[:-1]
        for k in keys:
            new[1:-1] |= k[1:] != k[:-1]
    least = ids[np.flatnonzero(new[:-1])][np.cumsum(new[:-1]) - 1] if len(ids) else ids
    use = new[:-1] | (new[1:] & (ids != least))
    return [k[use] for k in keys], ids[use]


def _by_bucket(keys: list[np.ndarray], ids: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row a bucket, with the keys and documents that fall into it."""
    bucket = (keys[0] >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    found, begin = np.unique(bucket[order], return_index=True)
    return _lists("bucket", found, begin, [*keys, ids], order)


def _lists(name: str, found, begin, columns, order) -> pa.RecordBatch:
    ends = np.append(begin, len(order)).astype(np.int32)
    lists = [
        pa.ListArray.from_arrays(ends, pa.array(c[order].view(np.int64))) for c in columns
    ]
    names = [name, *(f"c{i}" for i in range(len(columns)))]
    return pa.record_batch([pa.array(found.astype(np.int64)), *lists], names)


def _flat(table: pa.Table, name: str, kind=np.uint64) -> np.ndarray:
    return pc.list_flatten(table.column(name)).to_numpy().astype(np.int64).view(kind)


def _anchor_rows(p: RepeatParams, shards: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column(1))
            _, at, anchor = _windows(words, p.window)
            text = words.owner()[at]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            ids = batch.column(0).to_numpy()[text[fresh]]
            keys, ids = _fold([anchor[fresh]], ids, shards)
            if len(ids):
                yield _by_bucket(keys, ids, buckets)

    return run


def _recurring(shards: int, n_keys: int, with_owner: bool):
    """Keys of a bucket in more than one document, for each shard that has to know them.

    With the owner, the smallest document, only shards that have a larger one are told.
    """

    def run(table: pa.Table) -> pa.Table:
        keys = [_flat(table, f"c{i}") for i in range(n_keys)]
        ids = _flat(table, f"c{n_keys}", np.int64)
        order = np.lexsort((ids, *keys[::-1]))
        keys, ids = [k[order] for k in keys], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        owner, last = ids[begin][group], ids[np.append(begin[1:], len(ids)) - 1][group]
        use = (ids > owner) if with_owner else (owner < last)
        keys, ids, owner = [k[use] for k in keys], ids[use], owner[use]
        shard = _shard(ids, shards)
        order = np.lexsort((*keys[::-1], shard))
        same = np.zeros(len(order), bool)
        if len(order):
            same[1:] = shard[order][1:] == shard[order][:-1]
            for k in keys:
                same[1:] &= k[order][1:] == k[order][:-1]
        order = order[~same]
        found, begin = np.unique(shard[order], return_index=True)
        columns = [*keys, owner] if with_owner else keys
        return pa.Table.from_batches([_lists("shard", found, begin, columns, order)])

    return run


def _shipped(shards: int):
    """Documents by shard, as compressed Arrow tables: texts are moved twice, and so more cheaply."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = _shard(batch.column(0).to_numpy(), shards)
            order = np.argsort(shard, kind="stable")
            found, begin = np.unique(shard[order], return_index=True)
            rows = []
            for a, b in zip(begin, [*begin[1:], len(order)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                    writer.write_batch(batch.take(pa.array(order[a:b])))
                rows.append(sink.getvalue().to_pybytes())
            yield pa.record_batch(
                [pa.array(found), pa.array(rows, pa.binary())], ["shard", "docs"]
            )

    return run


def _unshipped(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for raw in table.column("docs"):
        with pa.ipc.open_stream(raw.as_buffer()) as stream:
            yield from slices(iter(stream))


def _candidate_rows(p: RepeatParams, shards: int, buckets: int):
    """Fingerprints of the windows whose anchor recurs."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        known = np.unique(_flat(told, "c0"))
        out = []
        for batch in _unshipped(docs):
            words = Words(batch.column(1))
            hashes, at, anchor = _windows(words, p.window)
            at = at[_found(anchor, known)]
            keys = _fingerprints(words, hashes, p.window, at)
            keys, ids = _fold(keys, batch.column(0).to_numpy()[words.owner()[at]], shards)
            if len(ids):
                out.append(_by_bucket(keys, ids, buckets))
        return pa.Table.from_batches(out, schema=_BUCKET_SCHEMA)

    return run


_LONGS = pa.list_(pa.int64())
_BUCKET_SCHEMA = pa.schema([("bucket", pa.int64()), *((f"c{i}", _LONGS) for i in range(3))])


def _fingerprints(words: Words, hashes: np.ndarray, size: int, at: np.ndarray) -> list[np.ndarray]:
    """128 bits for each window, from two independent hashes of its words."""
    return [sequences(h, size)[at] for h in (hashes, words.hashes(seed=1))]


def _found(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _passages(words: Words, ids: np.ndarray, known: list[np.ndarray], p: RepeatParams):
    """Runs of consecutive windows that an earlier document has: first word, and owners."""
    h1, h2, owner = known
    at = words.runs(p.window)
    if not len(h1) or not len(at):
        return
    one, two = _fingerprints(words, words.hashes(), p.window, at)
    slot = np.minimum(np.searchsorted(h1, one), len(h1) - 1)
    sure = (h1[slot] == one) & (h2[slot] == two) & (owner[slot] < ids[words.owner()[at]])
    at, owner = at[sure], owner[slot[sure]]
    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
        if end > begin:
            yield int(at[begin]), owner[begin:end]


# Letters of the automata: one alphabet for each place in a word's number, and one beyond them all.
BASE = 64
OTHER = "\x01"


def _letters(words: set[bytes]) -> dict[bytes, str]:
    """Words of phrases as short spellings of equal length.

    The automaton searches the branches of a state one by one, so few letters to a place keep every
    step short. Places have alphabets of their own, so that no match begins within a word.
    """
    width = 1
    while BASE**width < len(words):
        width += 1
    number = np.arange(len(words))[:, None] // BASE ** np.arange(width) % BASE
    spelled = (number + 0x100 + BASE * np.arange(width)).astype("<u4").tobytes().decode("utf-32-le")
    return {w: spelled[i * width : (i + 1) * width] for i, w in enumerate(words)}


def _blocks(passages: dict, most: int) -> Iterator[list]:
    """Passages by blocks of so many words in all, or of one longer passage."""
    block, total = [], 0
    for passage in passages:
        if block and total + len(passage) > most:
            yield block
            block, total = [], 0
        block.append(passage)
        total += len(passage)
    if block:
        yield block


def _kept_rows(p: RepeatParams):
    """What is left of each document of a shard."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        known = [_flat(told, "c0"), _flat(told, "c1"), _flat(told, "c2", np.int64)]
        order = np.argsort(known[0], kind="stable")
        known = [k[order] for k in known]
        held, passages = [], {}
        for batch in _unshipped(docs):
            words = Words(batch.column(1))
            ids = batch.column(0).to_numpy()
            listed = [words.text(i).split() for i in range(batch.num_rows)]
            flat = [w for ws in listed for w in ws]
            for start, owners in _passages(words, ids, known, p):
                passages[tuple(flat[start : start + len(owners) + p.window - 1])] = owners
            held.append((ids.tolist(), listed))
        letters = _letters({w for passage in passages for w in passage})
        width = len(next(iter(letters.values()), ""))
        covered = {}
        for block in _blocks(passages, p.automaton_words):
            automaton = ahocorasick.Automaton()
            for passage in block:
                automaton.add_word("".join([letters[w] for w in passage]), passages[passage])
            automaton.make_automaton()
            for part, (ids, listed) in enumerate(held):
                for row, (doc_id, ws) in enumerate(zip(ids, listed)):
                    if len(ws) >= p.window:
                        spelling = "".join([letters.get(w, OTHER * width) for w in ws])
                        for end, owners in automaton.iter(spelling):
                            # The passage's windows end with the words up to this one.
                            ends = np.flatnonzero(owners < doc_id) + end // width + 1 - len(owners)
                            covered.setdefault((part, row), set()).update(ends.tolist())
        rows = {"doc_id": [], "n_words": [], "n_removed": [], "kept_text": [], "spans": []}
        for part, (ids, listed) in enumerate(held):
            for row, (doc_id, ws) in enumerate(zip(ids, listed)):
                spans = _spans(covered.get((part, row), ()), p.window)
                kept, at = [], 0
                for a, b in spans:
                    kept += ws[at:a]
                    at = b
                kept += ws[at:]
                rows["doc_id"].append(doc_id)
                rows["n_words"].append(len(ws))
                rows["n_removed"].append(len(ws) - len(kept))
                rows["kept_text"].append(b" ".join(kept))
                rows["spans"].append([{"start": a, "end": b} for a, b in spans])
        return pa.table({k: pa.array(v, _KEPT_SCHEMA.field(k).type) for k, v in rows.items()})

    return run


def _digested(kept):
    """Only the digest of the kept text leaves the task."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        table = kept(docs, told)
        digest = [hashlib.sha256(x.as_py()).hexdigest() for x in table.column("kept_text")]
        return table.select(["doc_id", "n_words", "n_removed"]).append_column(
            "kept_sha256", pa.array(digest, pa.string())
        )

    return run


_KEPT_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_text", pa.binary()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def _spans(ends, window: int) -> list[tuple[int, int]]:
    """Stretches covered by windows, from the last words of the windows."""
    out: list[list[int]] = []
    for end in sorted(ends):
        if out and end - window + 1 <= out[-1][1]:
            out[-1][1] = end + 1
        else:
            out.append([end - window + 1, end + 1])
    return [tuple(x) for x in out]


def remove_repeats(
    docs: DataFrame,
    scratch: Scratch,
    params: RepeatParams = RepeatParams(),
    digest: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: `doc_id`, `n_words`, `n_removed`, `kept_text` and removed `spans`.

    A word goes if a window that covers it also starts in a document with a smaller id; windows are
    those of the input. `kept_text` (UTF-8 bytes) joins the other words by one space; with `digest`,
    `kept_sha256` stands in for it and for `spans` (word numbers, end exclusive). Null, empty and
    short texts have no windows and keep all words; repeats within one document alone stay. Repeated
    rows are one document and give a row each; rows without an id are left out; other columns are
    not read; no rows give no rows.

    1. Every window's anchor, a run of ANCHOR words chosen by its content, is counted by bucket.
    2. Documents go to shards by id, and each shard is told which of its anchors recur.
    3. Windows with such an anchor are confirmed by 128-bit fingerprints. The first document owns the
       phrase, and the shards that have a later one are told.
    4. Each shard joins consecutive phrases to passages, compiles these, as word sequences, into
       automata of bounded size and streams all its documents through them, which finds every
       occurrence; a window of a passage counts if its owner has a smaller id.

    A phrase is told once to a shard, however often it occurs there, and a bucket has at most two
    rows of it for each shard and batch, so that hot phrases weigh little anywhere.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(
        "doc_id is not null"
    )
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(64, -(-volume // params.shard_bytes))
    # About one anchor comes up every 25 bytes.
    buckets = max(1024, -(-volume // (25 * params.bucket_rows)))
    anchors = texts.mapInArrow(
        _anchor_rows(params, shards, buckets), "bucket long, c0 array<long>, c1 array<long>"
    )
    told = anchors.groupBy("bucket").applyInArrow(
        _recurring(shards, 1, False), "shard long, c0 array<long>"
    )
    shipped = texts.mapInArrow(_shipped(shards), "shard long, docs binary")
    windows = (
        shipped.groupBy("shard")
        .cogroup(told.groupBy("shard"))
        .applyInArrow(
            _candidate_rows(params, shards, buckets),
            "bucket long, c0 array<long>, c1 array<long>, c2 array<long>",
        )
    )
    owned = windows.groupBy("bucket").applyInArrow(
        _recurring(shards, 2, True), "shard long, c0 array<long>, c1 array<long>, c2 array<long>"
    )
    kept, schema = _kept_rows(params), "doc_id long, n_words long, n_removed long, "
    if digest:
        kept, schema = _digested(kept), schema + "kept_sha256 string"
    else:
        schema += "kept_text binary, spans array<struct<start: long, end: long>>"
    return (
        shipped.groupBy("shard").cogroup(owned.groupBy("shard")).applyInArrow(kept, schema)
    )
