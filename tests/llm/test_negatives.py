"""Hard negatives against brute force, with ties, zero and odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextile.llm import negatives
from sextile.sources.shared import Scratch


def brute(rows, params, every):
    table = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(x * params.scale) for x in v])
        table[i] = min(row, table.get(i, row))
    out = []
    for a, (own, v) in table.items():
        if a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), i, label) for i, (label, w) in table.items()]
        for s, p, _ in sorted(x for x in scores if x[2] == own and x[1] != a)[: params.positives]:
            fit = sorted(x for x in scores if x[2] != own and params.low * -s <= 100 * -x[0] <= params.high * -s)
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i, _) in enumerate(fit[: params.negatives])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(500):
        label = int(rng.integers(0, 4))
        v = (centres[rng.integers(0, 6)] + rng.normal(size=12)) * rng.choice([0.1, 1, 1, 5])
        rows.append((i, label, [float(x) for x in v]))
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(120)]
    rows += [(2000 + i, i % 2, [0.0] * 12) for i in range(4)] + [(2010, 1, []), (2020, 2, [1.0, 2.0])]
    rows += [(3000, None, rows[1][2]), (3001, 1, None), (3002, 1, [None] + [1.0] * 11), (None, 1, rows[1][2])]
    rows += [(3010, 1, [float("nan")] * 12), (3020, 1, [float("inf")] + [0.0] * 11), rows[5], rows[10]]
    rows += [(20, 3, rows[30][2])]
    return rows


@pytest.mark.parametrize(
    "params",
    [
        negatives.MineParams(),
        negatives.MineParams(bucket_rows=60, anchor_rows=9, seeds=20),
        negatives.MineParams(positives=2, negatives=50, low=0, high=100, bucket_rows=100, focus=1, seeds=1),
    ],
)
def test_mine(spark, rows, params):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    single = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    frame = frame.selectExpr("*", "'x' AS rank", "1 AS id").repartition(4)
    anchor = F.col("vec_id") % 10 == 0
    with Scratch(spark) as scratch:
        got = sorted(map(tuple, negatives.mine(frame, anchor, scratch, params).collect()))
        want = brute(single, params, 10)
        assert got == want and len(want) > 100
        assert negatives.mine(frame.limit(0), anchor, scratch, params).count() == 0
        assert negatives.mine(frame, F.lit(False), scratch, params).count() == 0


def test_candidates_leave_nothing_out():
    rng = np.random.default_rng(3)
    values = rng.integers(-300, 300, (400, 8))
    values[:5] = 0
    rows = negatives.Vectors(np.arange(400), np.zeros(400, int), values)
    fewer = 0
    for _ in range(200):
        anchor = rng.integers(-300, 300, 8).astype(float)
        scores = values @ anchor
        for least in (-1e9, -1e4, 0, 1, float(np.sort(scores)[-5]), 1e9):
            found = rows.candidates(anchor, least, 3)
            assert set(np.flatnonzero(scores >= least)) <= set(found)
            fewer += least > 1 and len(found) < 200
    assert fewer > 200


def test_large_components():
    values = np.array([[1 << 40, 3], [-(1 << 30), 1]])
    rows = negatives.Vectors(np.arange(2), np.zeros(2, int), values)
    assert rows.scores(np.arange(2), np.array([1 << 20, 7])).tolist() == [(1 << 60) + 21, -(1 << 50) + 7]
    with pytest.raises(ValueError):
        rows.scores(np.arange(2), np.array([1 << 24, 7]))
