"""The split against a plain ranking of every class."""

import hashlib
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sextile.operators import split as module
from sextile.operators.split import check_classes, split_counts, stratified_split, train_quotas

LABELS = st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(2, 10**6), min_size=1)


@given(LABELS)
def test_quotas(counts):
    quotas = train_quotas(counts)
    total = sum(counts.values())
    assert sum(quotas.values()) == total - math.ceil(total / 5)
    n_train = sum(quotas.values())
    for label, quota in quotas.items():
        assert math.floor(counts[label] * n_train / total) - 1 < quota <= counts[label]
        assert abs(quota - counts[label] * n_train / total) < 1


def by_hand(rows, seed=42):
    counts = {}
    for _, label in rows:
        counts[label] = counts.get(label, 0) + 1
    quotas, parts = train_quotas(counts), {}
    for label in counts:
        keys = [i for i, other in rows if other == label]
        keys.sort(key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))
        for rank, i in enumerate(keys):
            parts[i] = "train" if rank < quotas[label] else "test"
    return parts


@pytest.mark.parametrize("ranked", [0, 10, 100_000])
@pytest.mark.parametrize("lengths", [(1,), (2, 5), (1, 2, 3, 32)])
def test_split_is_exact(spark, monkeypatch, lengths, ranked):
    # One class holds most rows; with one hex digit many rows are left to be ranked.
    monkeypatch.setattr(module, "PREFIX_LENGTHS", lengths)
    monkeypatch.setattr(module, "RANKED_ROWS", ranked)
    rows = [(i, "big" if i % 3 else "mid" if i % 2 else "small") for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, label string").repartition(7)
    result = stratified_split(frame, "id", "label")
    got = {r.id: r.split for r in result.rows.collect()}
    assert got == by_hand(rows)
    assert result.classes == ["big", "mid", "small"]
    assert (result.n_samples, result.n_train, result.n_test) == (3000, 2400, 600)
    counts = {r.split: r.n for r in split_counts(result.rows).collect()}
    assert counts == {"train": 2400, "test": 600}


def test_string_keys_and_other_columns(spark):
    rows = [(f"k{i}", "x" if i < 12 else "y", i) for i in range(20)]
    frame = spark.createDataFrame(rows, "id string, label string, extra int")
    result = stratified_split(frame, "id", "label")
    assert result.rows.columns == ["id", "label", "extra", "split"]
    assert {r.id: r.split for r in result.rows.collect()} == by_hand([r[:2] for r in rows])


def test_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    rows = [(i, "ab"[i % 2]) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, label string")
    got = {r.id: r.split for r in stratified_split(frame, "id", "label").rows.collect()}
    assert got == by_hand(rows)


@pytest.mark.parametrize(
    "counts, message",
    [
        ({}, "no rows"),
        ({"a": 5, None: 1}, "no label"),
        ({"a": 5, "b": 1}, "single row"),
        ({"a": 2, "b": 2, "c": 2}, "too few"),
    ],
)
def test_labels_that_cannot_be_split(counts, message):
    with pytest.raises(ValueError, match=message):
        check_classes(counts)


def test_errors_reach_the_caller(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, label string")
    with pytest.raises(ValueError, match="no label"):
        stratified_split(frame, "id", "label")
