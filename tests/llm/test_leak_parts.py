"""Long parts of long items are leaks, and some common words of a short item are none."""

import random

from sextile.llm import decontaminate

COMMON = "what is the of a in and to for on".split()


def test_parts_and_short_items(spark):
    rng = random.Random(8)
    prose = lambda n: [rng.choice(COMMON) if rng.random() < 0.5 else f"p{rng.randrange(900)}" for _ in range(n)]
    long = {i: [f"q{rng.randrange(2000)}" for _ in range(n)] for i, n in ((1, 59), (2, 1000))}
    # All words of an item may be frequent: then none of its seeds is rare.
    long[3] = [rng.choice(COMMON) for _ in range(300)]
    short = {7: "what is the capital of france".split(), 8: "what is the of".split()}
    rows = {
        10: prose(80) + long[1][20:48] + prose(80),
        11: prose(300) + long[2][500:900] + prose(50),
        12: long[1][3:21],
        13: prose(60) + long[3][130:160] + prose(60),
        14: prose(60) + short[7] + prose(60),
        15: prose(60) + ["what", "is", "the"] + [f"p{i}" for i in range(40)],
        16: prose(60) + long[1][5:12] + prose(60),
        17: prose(60) + ["is", "the", "capital", "of", "france"] + prose(60),
    }
    rows |= {i: prose(500) for i in range(100, 140)}
    docs = [(i, " ".join(ws)) for i, ws in rows.items()]
    items = [(i, " ".join(ws)) for i, ws in (long | short).items()]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(d, b).collect()}
    want = {(10, 1), (11, 2), (12, 1), (13, 3), (14, 7), (17, 7)}
    assert want <= set(got)
    assert {k for k in got if k[1] in (1, 2, 7)} == want - {(13, 3)}
    assert (got[10, 1].start_word, got[10, 1].end_word) == (80, 108)
    assert 0.3 < got[10, 1].score < 0.5
