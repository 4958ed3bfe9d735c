"""Near duplicates by min-max hashing of word shingles, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .components import components
from .joins import join_keys
from .words import Words, mix, sequences, slices

# Ids are broadcast (8 bytes each) if they were counted and are no more than this.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class NearParams:
    """Words of a shingle, least similarity in percent, and the shape of the signatures.

    Each of `permutations` hashes gives a minimum and a maximum; `band` values make a key. With 64
    and 5 there are 25 keys, and two sets of similarity 0.85 share none in 4 of ten million cases,
    of similarity 0.8 in 5 of a hundred thousand.
    """

    shingle: int = 5
    percent: int = 80
    permutations: int = 64
    band: int = 5
    # A block of a large cluster has about so many documents at most, and shingles unless it is one
    # text. Rows are dealt by hash, so blocks differ by chance.
    block_rows: int = 1000
    block_shingles: int = 1 << 20


def _shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and where each text's begin.

    A text of fewer than `k` words has its whole sequence as its one shingle, one without words has
    none.
    """
    hashes = words.hashes()
    n = np.diff(words.first)
    full = words.runs(k)
    every = sequences(hashes, k)[full]
    at = np.concatenate([[0], np.cumsum(np.maximum(n - k + 1, 0))])
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.array(
            [sequences(hashes[words.first[i] : words.first[i + 1]], int(n[i]))[0] for i in short]
        )
        # The count of words goes in, so that short sequences never meet full ones.
        whole ^= n[short].astype(np.uint64) << np.uint64(57)
        every = np.insert(every, at[short], whole)
        at = np.concatenate([[0], np.cumsum(np.where(n < k, n > 0, n - k + 1))])
    return every, at


def _sets(texts: pa.Array, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    every, at = _shingles(Words(texts, lower=True), k)
    return [np.unique(every[a:b]) for a, b in zip(at, at[1:])], every, at


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (
        rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
        rng.integers(0, 1 << 63, n, dtype=np.uint64),
    )


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _signatures(every: np.ndarray, at: np.ndarray, params: NearParams) -> np.ndarray:
    """Both extremes under each permutation, one row a text; rows of empty sets mean nothing."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, 2 * params.permutations), np.uint32)
    if len(full):
        begin = at[:-1][full]
        for j, (a, b) in enumerate(zip(*_multipliers(params.permutations))):
            x = ((every * a + b) >> np.uint64(32)).astype(np.uint32)
            out[full, 2 * j] = np.minimum.reduceat(x, begin)
            out[full, 2 * j + 1] = np.maximum.reduceat(x, begin)
    return out


def _keys(signatures: np.ndarray, params: NearParams) -> np.ndarray:
    # A band takes values far apart, so that it rarely has both extremes of one permutation.
    bands = signatures.shape[1] // params.band
    parts = signatures[:, : bands * params.band].reshape(len(signatures), params.band, bands)
    column = np.arange(bands, dtype=np.uint64)[None, :] * np.ones((len(signatures), 1), np.uint64)
    out = mix(column + np.uint64(1))
    for j in range(params.band):
        out = mix(out ^ parts[:, j].astype(np.uint64))
    return out


def _signed_rows(params: NearParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, every, at = _sets(batch.column(1), params.shingle)
            keys = _keys(_signatures(every, at, params), params)
            ids = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            lists = pa.ListArray.from_arrays(
                np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), _signed(keys.ravel())
            )
            size = pa.array([len(x) for x in sets], pa.int64())
            yield pa.record_batch(
                [batch.column(0), size, pa.array(ids, pa.binary()), lists],
                ["doc_id", "n_shingles", "set_id", "keys"],
            )

    return run


def _set_rows(params: NearParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, _, _ = _sets(batch.column(1), params.shingle)
            yield pa.record_batch(
                [batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary())],
                ["doc_id", "shingles"],
            )

    return run


def _linked(params: NearParams):
    """Documents of one block, or of two, with the smallest one they are linked to there."""

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        raw = group.column("shingles").to_pylist()
        sets = [np.frombuffer(raw[i], np.uint64) for i in order]
        parent = link_sets(sets, params.percent)
        return pa.table({"u": ids, "v": ids[parent]})

    return run


def link_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the smallest number of a set it is reachable from by links."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    value = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(value) else new
    column, owner = column[shared], owner[shared]
    if len(column):
        column = np.concatenate([[0], np.cumsum(np.diff(column) > 0)])
    common = np.zeros((n, n))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((n, 4096), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    link = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(link, True)
    label = np.arange(n)
    while True:
        low = np.where(link, label[None, :], n).min(axis=1, initial=n)
        low = np.minimum(low, label)[label]
        low = np.minimum(low, np.where(link, low[None, :], n).min(axis=1, initial=n))
        if (low == label).all():
            return label
        label = low


def near_duplicates(
    docs: DataFrame,
    scratch: Scratch,
    params: NearParams = NearParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: `doc_id`, `n_shingles` and `component_id`.

    Documents whose shingle sets are similar enough are linked; `component_id` is the smallest
    reachable id, the document's own if it has no link. A-Z count as a-z. Null texts and texts
    without words have an empty set and no links; texts shorter than a shingle have one shingle.
    Repeated rows count once, rows without an id are left out, and an id must not have unlike texts;
    other columns are not read; no rows give no rows.

    Documents with equal sets are one class from the start and only its smallest id goes on. Classes
    that share a band key form clusters. Every class's set is fetched once for its cluster, which is
    dealt into blocks of bounded size by hash. Links are first looked for in each two blocks that
    follow each other, which joins the parts of a family across its blocks. Members that are not in
    the main part of their cluster then are dealt into chunks of the same bound, and each chunk meets
    each block in a group of its own, so no group holds more than two blocks. No pairs are shipped or
    kept, and none is left out.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(
        "doc_id is not null"
    )
    schema = "doc_id long, n_shingles long, set_id binary, keys array<long>"
    signed = scratch.table(texts.mapInArrow(_signed_rows(params), schema), "signed")
    # Equal sets are counted with partial sums; only those that recur need a join.
    known = signed.where("set_id is not null")
    first = known.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    first = scratch.table(first.where("n > 1").drop("n"), "equal-sets")
    members = scratch.table(
        join_keys(known, first, ["set_id"], "left").select(
            "doc_id",
            F.coalesce("rep", "doc_id").alias("rep"),
            "n_shingles",
            F.when(F.col("doc_id") == F.coalesce("rep", "doc_id"), F.col("keys")).alias("keys"),
        ),
        "members",
    )
    keyed = scratch.table(
        members.where("keys is not null").select("rep", F.explode("keys").alias("key")), "keys"
    )
    shared = keyed.groupBy("key").agg(F.min("rep").alias("v"), F.max("rep").alias("last"))
    stars = keyed.join(shared.where("v < last").drop("last"), "key")
    clusters = components(stars.select(F.col("rep").alias("u"), "v").distinct(), scratch)
    links = _confirmed(texts, members, clusters, params, scratch)
    roots = components(links, scratch).select(F.col("node").alias("rep"), "root")
    placed = members.select("doc_id", "rep").distinct().join(roots, "rep", "left")
    return (
        signed.select("doc_id", "n_shingles")
        .distinct()
        .join(placed, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "rep", "doc_id").alias("component_id"))
    )


def _room(params: NearParams):
    """How many blocks the rows of a group need."""
    return F.greatest(
        F.ceil(F.count("*") / params.block_rows),
        F.ceil(F.sum("n_shingles") / params.block_shingles),
    )


def _confirmed(texts, members, clusters, params: NearParams, scratch: Scratch) -> DataFrame:
    """Links that join up whatever is linked within a cluster."""
    sized = members.where("keys is not null").select(F.col("doc_id").alias("node"), "n_shingles").distinct()
    clustered = scratch.table(clusters.join(sized, "node"), "clustered")
    room = clustered.groupBy("root").agg(_room(params).alias("blocks"))
    dealt = clustered.join(room, "root").select(
        F.col("node").alias("doc_id"),
        F.col("root").alias("cluster"),
        "blocks",
        F.expr("pmod(xxhash64(node), blocks)").alias("block"),
    )
    few = clustered.count() <= BROADCAST_ROWS
    ids = clustered.select(F.col("node").alias("doc_id"))
    wanted = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = wanted.mapInArrow(_set_rows(params), "doc_id long, shingles binary")
    held = scratch.table(dealt.join(sets, "doc_id"), "sets")
    link = _linked(params)
    # Block i meets block i + 1, around the circle; up to three blocks have all met then.
    turns = F.expr(
        "case when blocks < 3 then array(0L) else array(block, pmod(block + 1, blocks)) end"
    )
    near_by = held.select("cluster", F.explode(turns).alias("turn"), "doc_id", "shingles")
    inside = scratch.table(
        near_by.groupBy("cluster", "turn").applyInArrow(link, "u long, v long"), "inside"
    )
    split = held.where("blocks > 3")
    if not split.take(1):
        return inside
    roots = components(inside, scratch).withColumnRenamed("node", "doc_id")
    light = split.select("cluster", "blocks", "block", "doc_id").join(roots, "doc_id", "left")
    parts = scratch.table(light.withColumn("root", F.coalesce("root", "doc_id")), "parts")
    main = (
        parts.groupBy("cluster", "root").count()
        .groupBy("cluster").agg(F.max(F.struct("count", "root")).alias("most"))
        .select("cluster", F.col("most.root").alias("main"))
    )
    others = parts.join(main, "cluster").where("root <> main").select("cluster", "blocks", "doc_id")
    others = scratch.table(others.join(sized.withColumnRenamed("node", "doc_id"), "doc_id"), "others")
    rooms = others.groupBy("cluster").agg(_room(params).alias("chunks"))
    visitors = others.join(rooms, "cluster").selectExpr(
        "cluster", "blocks", "doc_id", "pmod(xxhash64(doc_id, 1), chunks) as chunk"
    )
    # A chunk of members outside the main part meets each block in a group of its own.
    guests = split.select("doc_id", "block", "shingles").join(visitors, "doc_id").selectExpr(
        "cluster", "explode(sequence(0L, blocks - 1)) as at", "chunk", "doc_id", "shingles", "block"
    )
    hosts = split.join(rooms, "cluster").selectExpr(
        "cluster", "block as at", "explode(sequence(0L, chunks - 1)) as chunk", "doc_id", "shingles"
    )
    met = guests.where("block <> at").drop("block").unionByName(hosts)
    across = met.groupBy("cluster", "at", "chunk").applyInArrow(link, "u long, v long")
    return scratch.table(inside.union(across), "confirmed")
