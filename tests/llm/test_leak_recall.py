"""Edited copies of items, common words, and all documents against all items."""

import random

import pytest

from sextile.llm import decontaminate


def zipf(rng, n, words=4000):
    return [f"w{min(int(rng.paretovariate(0.9)), words)}" for _ in range(n)]


@pytest.mark.parametrize("step", [2, 3, 4, 6])
def test_edited_copies(spark, step):
    rng = random.Random(step)
    items = {i: zipf(rng, 60) for i in range(40)}
    docs = []
    for i, item in items.items():
        edited = [w if (j + i) % step else f"x{rng.randrange(10_000)}" for j, w in enumerate(item)]
        docs.append((i, " ".join(zipf(rng, 200) + edited + zipf(rng, 100))))
    docs += [(1000 + i, " ".join(zipf(rng, 300))) for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()}
    wanted = {(i, i) for i in items}
    p = decontaminate.LeakParams()
    ids = {w: n for n, w in enumerate({w for _, t in docs for w in t.split()} | {w for ws in items.values() for w in ws})}
    if step > 2:
        assert len(got & wanted) >= 36
    import numpy as np

    # What is found is what the alignment of all documents with all items calls long enough.
    sure = set()
    arrays = {i: np.array([ids[w] for w in ws]) for i, ws in items.items()}
    for doc, text in docs[:60]:
        own = np.array([ids[w] for w in text.split()])
        for i, item in arrays.items():
            if decontaminate.align(item, own, p)[0] >= p.match * p.least_words:
                sure.add((doc, i))
    found = {x for x in got if x[0] in {d for d, _ in docs[:60]}}
    assert found <= sure | wanted
    assert len(found & sure) >= (0.9 if step > 2 else 0.5) * len(sure)


def test_common_words_are_no_leak(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(zipf(rng, 300))) for i in range(50)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = [(1, "w1"), (2, "w1 w2"), (3, "w1 w1 w2"), (4, "w2")]
    b = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.leaks(d, b).count() == 0
