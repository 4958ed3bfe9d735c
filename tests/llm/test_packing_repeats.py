"""Rows that repeat are packed each, none over another."""

import numpy as np

from sextile.llm import packing
from sextile.sources.shared import Scratch


def test_repeated_rows_have_places_of_their_own(spark):
    rows = [(1, "one two three"), (2, "a b"), (3, None), (4, "long " * 5000)]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string").repartition(3)
    with Scratch(spark) as scratch:
        frame = packing.pack(docs, scratch)
        got = frame.toPandas()
        whole = {r.sequence_id: r for r in packing.sequences(frame).collect()}
    assert (got.groupby(["doc_id", "start"]).size() == 3).all()
    for sequence, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 2048
        ids = bytes(whole[sequence].ids)
        for at, part in zip(own.offset, own.ids):
            assert ids[4 * at : 4 * at + len(part)] == bytes(part)
