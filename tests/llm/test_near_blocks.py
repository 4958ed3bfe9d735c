"""Groups of a large cluster stay bounded and lose no link."""

import random

from sextile.llm import near
from sextile.sources.shared import Scratch

ROWS = 20


def test_groups_of_a_large_family_are_bounded(spark, monkeypatch):
    """A third of the family is one part, the others hardly link; all share a key by way of copies."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(300):
        copy = list(base)
        # The share of edits runs from nearly equal to beyond the threshold.
        for at in rng.sample(range(200), i % 3 * 4 + 1):
            copy[at] = f"e{rng.randrange(9)}"
        texts[i] = " ".join(copy)
    real = near.link_sets

    def bounded(sets, percent):
        # Blocks are dealt by hash, so they differ by chance.
        assert len(sets) <= 2 * 2 * ROWS, len(sets)
        return real(sets, percent)

    monkeypatch.setattr(near, "link_sets", bounded)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    with Scratch(spark) as scratch:
        params = near.NearParams(shingle=3, percent=88, block_rows=ROWS, band=2)
        got = {r.doc_id: r.component_id for r in near.near_duplicates(docs, scratch, params).collect()}
    sets = {}
    for i, text in texts.items():
        words = text.split()
        sets[i] = {tuple(words[j : j + 3]) for j in range(len(words) - 2)}
    root = {i: i for i in sets}
    for a in sets:
        for b in range(a + 1, len(sets)):
            common = len(sets[a] & sets[b])
            if 100 * common >= 88 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                if low != high:
                    root = {i: low if r == high else r for i, r in root.items()}
    assert len(set(root.values())) > 3 * ROWS
    assert got == root
