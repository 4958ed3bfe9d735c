"""Hard negatives by coordinate pruning in length buckets, with exact integer scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch

# Floating cosines are compared with this much room, so that no row is lost to rounding.
_ROOM = 1e-7
# Sums of products below this are exact in doubles, in whatever order they are added.
_EXACT = 1 << 53


@dataclass(frozen=True)
class MineParams:
    """How many of each, the scores a negative may have, and the sizes of the search.

    Components are `floor(scale * x)`. A negative's score is from `low` to `high` percent of the
    positive's. `focus` coordinates of an anchor, its largest, choose the candidates in a bucket of
    some `bucket_rows` rows, after a look at `seeds` rows has set a threshold. Anchors meet buckets in
    blocks of `anchor_rows`. Both are fewer where the matrix would take more than `matrix_bytes`.
    """

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    focus: int = 3
    seeds: int = 256
    bucket_rows: int = 8192
    anchor_rows: int = 16384
    matrix_bytes: int = 32 << 20

    def parts(self, n: int, rows: int, dims: int) -> int:
        """How many matrices `n` vectors of `dims` components are dealt to."""
        return max(1, -(-n // max(1, min(rows, self.matrix_bytes // (8 * max(dims, 1))))))


class Vectors:
    """Rows of integer vectors with sorted lists of their coordinates, made as they are asked for."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        self.ids, self.labels = ids, labels
        self.top = int(np.abs(values).max(initial=0))
        self.values = values.astype(float) if self.top < _EXACT else values
        floats = values.astype(float)
        self.length = np.sqrt((floats * floats).sum(axis=1))
        self._unit = floats / np.where(self.length > 0, self.length, 1)[:, None]
        self.least, self.most = self.length.min(initial=np.inf), self.length.max(initial=0)
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Coordinate `f` of the unit vectors in ascending order, and the rows in that order."""
        if f not in self._lists:
            rows = np.argsort(self._unit[:, f], kind="stable")
            self._lists[f] = self._unit[rows, f], rows
        return self._lists[f]

    def part(self, rows: np.ndarray) -> Vectors:
        return Vectors(self.ids[rows], self.labels[rows], self.values[rows])

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products with some rows."""
        limit = self.top * int(np.abs(anchor).max(initial=0)) * len(anchor)
        if limit < _EXACT:
            return (self.values[rows] @ anchor.astype(float)).astype(np.int64)
        if limit >= 1 << 63:
            raise ValueError("scores do not fit into 64 bits")
        return self.values[rows].astype(np.int64) @ anchor.astype(np.int64)

    def seeds(self, anchor: np.ndarray, n: int) -> np.ndarray:
        """Rows that go furthest with the anchor's largest coordinate."""
        f = int(np.abs(anchor).argmax())
        rows = self.list(f)[1]
        return rows[-n:] if anchor[f] > 0 else rows[:n]

    def candidates(self, anchor: np.ndarray, least: float, focus: int) -> np.ndarray:
        """Rows that may have a score of `least` or more.

        A bucket's longest row (its shortest, for a negative score) gives the cosine that is needed.
        A vector that near to the anchor has an angle to each axis which differs from the anchor's by
        no more than the angle of that cosine, so its coordinate lies in a range of the sorted list.
        """
        n = len(self.ids)
        size = float(np.sqrt((anchor.astype(float) ** 2).sum()))
        longest = self.most if least > 0 else self.least
        if not size or not longest:
            return np.arange(n) if least <= 0 else np.arange(0)
        cosine = least / (size * longest)
        if cosine > 1 + _ROOM:
            return np.arange(0)
        if cosine <= -1:
            return np.arange(n)
        reach = np.arccos(min(cosine, 1.0))
        met = np.zeros(n, np.uint8)
        axes = np.argsort(-np.abs(anchor), kind="stable")[:focus]
        for f in axes:
            own = np.arccos(np.clip(anchor[f] / size, -1, 1))
            values, rows = self.list(int(f))
            low = np.cos(min(np.pi, own + reach)) - _ROOM
            high = np.cos(max(0.0, own - reach)) + _ROOM
            met[rows[np.searchsorted(values, low) : np.searchsorted(values, high, side="right")]] += 1
        return np.flatnonzero(met == len(axes))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` highest scores, equal ones by id."""
    if len(ids) > k:
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def best_positives(
    anchors: Vectors, bucket: Vectors, params: MineParams
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor's number the best rows of its label in a bucket: ids and scores."""
    k = params.positives
    parts: dict[int, Vectors] = {}
    for i, (own, label) in enumerate(zip(anchors.ids.tolist(), anchors.labels.tolist())):
        if label not in parts:
            parts[label] = bucket.part(np.flatnonzero(bucket.labels == label))
        part, anchor = parts[label], anchors.values[i]
        if not len(part.ids):
            continue
        least = -np.inf
        seeds = part.seeds(anchor, params.seeds)
        seeds = seeds[part.ids[seeds] != own]
        if len(seeds) >= k:
            least = float(np.partition(part.scores(seeds, anchor), -k)[-k])
        rows = part.candidates(anchor, least, params.focus)
        rows = rows[part.ids[rows] != own]
        scores = part.scores(rows, anchor)
        best = _best(part.ids[rows], scores, k)
        yield i, part.ids[rows][best], scores[best]


def best_negatives(
    anchors: Vectors, positives: list[list[int]], bucket: Vectors, params: MineParams
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each anchor's number and each of its positives' scores the best rows of other labels."""
    k = params.negatives
    for i, (label, wanted) in enumerate(zip(anchors.labels.tolist(), positives)):
        anchor = anchors.values[i]
        # A negative positive's score leaves no room: its upper bound is below its lower one.
        ranges = [(j, -(-params.low * p // 100), params.high * p // 100) for j, p in enumerate(wanted) if p >= 0]
        if not ranges:
            continue
        seeds = bucket.seeds(anchor, params.seeds)
        seeds = seeds[bucket.labels[seeds] != label]
        known = bucket.scores(seeds, anchor)
        least = np.inf
        for _, low, high in ranges:
            inside = known[(known >= low) & (known <= high)]
            least = min(least, int(np.partition(inside, -k)[-k]) if len(inside) >= k else low)
        rows = bucket.candidates(anchor, least, params.focus)
        rows = rows[bucket.labels[rows] != label]
        scores = bucket.scores(rows, anchor)
        for j, low, high in ranges:
            fit = np.flatnonzero((scores >= low) & (scores <= high))
            best = fit[_best(bucket.ids[rows[fit]], scores[fit], k)]
            if len(best):
                yield i, j, bucket.ids[rows[best]], scores[best]


_BLOB = "part int, ids binary, labels binary, width int, dims int, vectors binary, positives binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, id, label, vector, positives) as one row for each batch, padded with zeros."""
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = batch.column("vector")
        size = np.diff(vectors.offsets.to_numpy())
        dims = int(size.max(initial=0))
        values = np.zeros((batch.num_rows, dims), np.int64)
        values[np.arange(dims) < size[:, None]] = vectors.flatten().to_numpy()
        width = 4 if np.abs(values).max(initial=0) < 1 << 31 else 8
        scores = batch.column("positives")
        places = np.diff(scores.offsets.to_numpy()).astype("<i8").tobytes()
        blob = {
            "part": pa.array([batch.column("part")[0].as_py()], pa.int32()),
            "ids": pa.array([batch.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "labels": pa.array([batch.column("label").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "width": pa.array([width], pa.int32()),
            "dims": pa.array([dims], pa.int32()),
            "vectors": pa.array([values.astype(f"<i{width}").tobytes()], pa.binary()),
            "positives": pa.array([places + scores.flatten().to_numpy().astype("<i8").tobytes()], pa.binary()),
        }
        yield pa.record_batch(list(blob.values()), names=list(blob))


def _unpacked(blobs: pa.Table, dims: int) -> tuple[Vectors, list[list[int]]]:
    ids, labels, vectors, positives = [], [], [], []
    for row in blobs.to_pylist():
        own = np.frombuffer(row["ids"], "<i8")
        ids.append(own)
        labels.append(np.frombuffer(row["labels"], "<i8"))
        part = np.zeros((len(own), dims), np.int64)
        part[:, : row["dims"]] = np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(len(own), -1)
        vectors.append(part)
        at = np.frombuffer(row["positives"], "<i8")
        scores = iter(at[len(own) :].tolist())
        positives += [[next(scores) for _ in range(n)] for n in at[: len(own)].tolist()]
    return Vectors(np.concatenate(ids), np.concatenate(labels), np.concatenate(vectors)), positives


def _pairs(anchors: DataFrame, buckets: DataFrame, search: Callable, schema: str) -> DataFrame:
    """`search` over each block of anchors with each bucket; both are few rows of many vectors.

    A group is one block and one bucket, both of bounded size.
    """
    n_blocks, n_buckets = (t.agg(F.max("part")).first()[0] for t in (anchors, buckets))
    if n_blocks is None or n_buckets is None:
        return anchors.sparkSession.createDataFrame([], schema)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    guests = anchors.select(
        F.col("part").alias("block"), every(n_buckets).alias("bucket"), F.lit(True).alias("anchors"), *anchors.columns[1:]
    )
    hosts = buckets.select(
        every(n_blocks).alias("block"), F.col("part").alias("bucket"), F.lit(False).alias("anchors"), *buckets.columns[1:]
    )

    def run(group: pa.Table) -> pa.Table:
        is_anchor = group.column("anchors").to_numpy()
        sides = group.filter(pa.array(is_anchor)), group.filter(pa.array(~is_anchor))
        dims = max(group.column("dims").to_pylist())
        if not all(len(side) for side in sides):
            return search(None, None, None)
        (left, positives), (right, _) = (_unpacked(side, dims) for side in sides)
        return search(left, positives, right)

    return guests.unionByName(hosts).groupBy("block", "bucket").applyInArrow(run, schema)


def _columns(names: list[str], rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})


def _first(found: DataFrame, key: list[str], k: int, id_col: str, score: str) -> DataFrame:
    place = Window.partitionBy(*key).orderBy(F.desc(score), id_col)
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    anchor: Column,
    scratch: Scratch,
    params: MineParams = MineParams(),
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """Hard negatives of every anchor and positive: `anchor_id`, `positive_id`, `rank`, `negative_id`,
    `positive_score` and `negative_score`.

    Anchors are the rows for which `anchor`, an expression over the id column, holds. A score is the
    inner product of integer components with the anchor's; higher ones come first, equal ones by id.
    An anchor's positives are the best other rows of its label. Negatives have another label and a
    score within the percentages of the positive's; there are none for a negative score. Rows with a
    null id, label or vector, or with a null or non-finite component take no part. Vectors of unlike
    length are compared as if zeros followed, a zero vector has score 0. Repeated rows count once; of
    unlike rows under one id the smallest counts. Other columns are not read, no rows give none.

    Rows are sorted by length into buckets, each held as one matrix. Blocks of anchors meet buckets in
    groups of bounded size; a group returns a few rows for each anchor, of which Spark takes the best.
    """
    whole = F.col(vector_col).isNotNull() & F.forall(
        vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))
    )
    given = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & whole).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * params.scale)).alias("vector"),
        anchor.alias("is_anchor"),
    )
    one = given.groupBy("id").agg(F.min(F.struct("label", "vector", "is_anchor")).alias("row"))
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    table = scratch.table(one.select("id", "row.*").withColumn("length", length), "vectors")
    none = F.lit(None).cast("array<long>")
    empty = F.coalesce(none, F.array().cast("array<long>")).alias("positives")
    n, dims = table.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    n_buckets = params.parts(n, params.bucket_rows, dims)
    buckets = _packs(
        table.repartitionByRange(n_buckets, "length", "id").select("id", "label", "vector", empty),
        scratch,
        "buckets",
    )
    anchors = table.where("is_anchor").select("id", "label", "vector")
    n_blocks = params.parts(anchors.count(), params.anchor_rows, dims)

    def positives(left: Vectors | None, _, right: Vectors | None) -> pa.Table:
        names = ["anchor_id", "positive_id", "positive_score"]
        if left is None:
            return _columns(names, [])
        return _columns(
            names,
            [
                (int(left.ids[i]), d, s)
                for i, ids, scores in best_positives(left, right, params)
                for d, s in zip(ids.tolist(), scores.tolist())
            ],
        )

    blocks = _packs(anchors.withColumn("positives", empty).repartition(n_blocks, "id"), scratch, "anchors")
    found = _pairs(blocks, buckets, positives, "anchor_id long, positive_id long, positive_score long")
    near = scratch.table(
        _first(found, ["anchor_id"], params.positives, "positive_id", "positive_score"), "positives"
    )
    # At most `positives` rows for each anchor, with unlike places.
    listed = near.groupBy(F.col("anchor_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p")
    )
    wanted = anchors.join(listed, "id").select("id", "label", "vector", F.col("p.positive_score").alias("positives"))
    blocks = _packs(wanted.repartition(n_blocks, "id"), scratch, "asking")

    def negatives(left: Vectors | None, scores: list[list[int]], right: Vectors | None) -> pa.Table:
        names = ["anchor_id", "place", "negative_id", "negative_score"]
        if left is None:
            return _columns(names, [])
        return _columns(
            names,
            [
                (int(left.ids[i]), j + 1, d, s)
                for i, j, ids, scored in best_negatives(left, scores, right, params)
                for d, s in zip(ids.tolist(), scored.tolist())
            ],
        )

    schema = "anchor_id long, place long, negative_id long, negative_score long"
    found = _pairs(blocks, buckets, negatives, schema)
    hard = _first(found, ["anchor_id", "place"], params.negatives, "negative_id", "negative_score")
    owners = near.withColumnRenamed("rank", "place")
    return hard.join(owners, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _packs(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The partitions of `rows` as rows of whole matrices, numbered from 0."""
    placed = rows.withColumn("part", F.spark_partition_id())
    return scratch.table(placed.mapInArrow(_packed, _BLOB), name)
