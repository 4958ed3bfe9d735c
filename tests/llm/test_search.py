"""Ranked search against brute force, with ties, repeated rows and several blocks."""

import math
import random
import re

import numpy as np
import pytest

from sextile.llm import search
from sextile.sources.shared import Scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").encode().lower().decode())


def brute(docs, items, top):
    lists = [(i, terms(t)) for i, t in docs if i is not None]
    lists = [(i, ts) for i, ts in lists if ts]
    n_docs, total = len(lists), sum(len(ts) for _, ts in lists)
    df = {}
    for _, ts in lists:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items.items():
        scores = []
        for i, ts in lists:
            m = 75 + (25 * len(ts) * n_docs) // total
            score = 0
            for t in terms(text):
                tf = ts.count(t)
                if tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["é1", "Ünder", "日本", "X_y", "a\x00b", "don't"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(300)]
    docs += [(400 + i, "w1 w2 w3") for i in range(30)]
    docs += [(500, None), (501, ""), (502, " .\n"), (503, "w7 " * 40_000), (None, "w1"), (7, docs[7][1])]
    items = {i: " ".join(rng.choices(words, k=rng.randrange(1, 12))) for i in range(20)}
    items |= {30: None, 31: "", 32: "nowhere at all", 33: "W1 w1 w2"}
    return docs, items


@pytest.mark.parametrize(
    "params",
    [
        search.SearchParams(),
        search.SearchParams(top=5, block_docs=16),
        search.SearchParams(top=3, item_bytes=60, block_postings=100),
    ],
)
def test_search(spark, rows, params):
    docs, items = rows
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS item_id")
    asked = [*items.items(), (33, "W1 w1 w2"), (None, "w1")]
    bench = spark.createDataFrame(asked, "item_id long, text string").selectExpr("*", "1 AS rank")
    with Scratch(spark) as scratch:
        got = search.search(frame.repartition(3), bench, scratch, params).collect()
        assert sorted(map(tuple, got)) == brute(docs, items, params.top)
        assert search.search(frame.limit(0), bench, scratch, params).count() == 0
        assert search.search(frame, bench.limit(0), scratch, params).count() == 0


def test_few_accumulators():
    """A rare term settles the best documents; the frequent one makes no accumulators for the rest."""
    n = 5000
    rare, common = np.arange(20), np.arange(n)
    owner = np.concatenate([rare, common])
    term = np.concatenate([np.zeros(20, int), np.ones(n, int)])
    queries = search._Queries([1], np.arange(2, dtype=np.uint64), [(np.array([0, 1]), np.array([1, 1]))])
    weights = search.Weights(n, n * 10, np.array([20, n - 1]))
    top = search._Top(10)
    made = search.search_block(
        np.arange(n), np.full(n, 10), term, owner, np.ones(len(term), int), queries, weights, [top], 10
    )
    assert made == 20
    assert top.doc.tolist() == list(range(10))
