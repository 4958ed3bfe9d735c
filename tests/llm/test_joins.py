"""Joins beyond the bound of a broadcast give the same rows."""

import pytest

from sextile.llm import exact, joins, near
from sextile.sources.shared import Scratch


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join(spark, monkeypatch, how):
    """A key with most of the rows, one without a partner, one that is null."""
    rows = spark.range(200).selectExpr("id AS doc_id", "CASE WHEN id < 150 THEN 1 WHEN id < 190 THEN id END AS k")
    keys = spark.range(160).selectExpr("id AS k", "id * 2 AS v")
    keys = keys.drop("v") if how == "left_semi" else keys
    expected = sorted(map(str, joins.join_keys(rows, keys, ["k"], how).collect()))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    assert sorted(map(str, joins.join_keys(rows, keys, ["k"], how).collect())) == expected


def test_groups_by_salted_joins(spark, monkeypatch):
    texts = ["a b c d e f g", "A b c d e f g", "x", "x", None, "", "a b c d e f g h", "z y"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def groups():
        with Scratch(spark) as scratch:
            frames = exact.exact_groups(docs, scratch), near.near_duplicates(docs, scratch)
            return [sorted(map(tuple, f.collect())) for f in frames]

    expected = groups()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    assert groups() == expected
