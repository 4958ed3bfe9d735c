"""Shared lines against brute force, with frequent lines that go over many partitions."""

import random

import pytest

from sextile.llm import lines
from sextile.sources.shared import Scratch


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    frequent = ["Subscribe  now", " all rights reserved\t", "MENU"]
    pool = [f"line {i} é" for i in range(80)] + ["", " \t", "\x0b", "É"]
    docs = []
    for i in range(120):
        text = rng.choices(pool, k=rng.randrange(0, 12)) + rng.choices(frequent, k=rng.randrange(3))
        docs.append((i, "\n".join(x.upper() if rng.random() < 0.2 else x for x in text)))
    docs += [(200 + i, "hot") for i in range(300)]
    docs += [(600, None), (601, ""), (602, "\n\n"), (603, "own line\n" * 3000 + "Hot"), (None, "hot")]
    docs += [(3, docs[3][1]), (3, "hot\nline 1 é\nhot"), (4, "rare\nrare")]
    return docs


def key(line):
    return line.strip(lines.BLANKS).encode().lower().decode()


def brute(docs, least_docs, keep_first, ids):
    docs = [(i, t or "") for i, t in docs if i is not None]
    places = {}
    for row in set(docs):
        for pos, line in enumerate(row[1].split("\n")):
            if key(line):
                places.setdefault(key(line), []).append((row[0], ids[row[1]], pos))
    gone = {
        k: {p[:2] + (p[2],) for p in sorted(ps)[1 if keep_first else 0 :]}
        for k, ps in places.items()
        if len({p[0] for p in ps}) >= least_docs
    }
    out = []
    for i, text in docs:
        split = text.split("\n")
        kept = [x for pos, x in enumerate(split) if (i, ids[text], pos) not in gone.get(key(x), ())]
        out.append((i, len(split), len(split) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("least_docs,keep_first,parts", [(10, False, 1), (10, False, 60), (2, True, 60), (3, True, 4)])
def test_lines(spark, rows, least_docs, keep_first, parts):
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS pos", "1 AS n_lines")
    ids = {r[0] or "": r[1] for r in frame.selectExpr("text", "xxhash64(coalesce(text, ''))").collect()}
    params = lines.LineParams(least_docs=least_docs, keep_first=keep_first, row_lines=100)
    settings = {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "7",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        with Scratch(spark) as scratch:
            bitmaps = scratch.table(lines.line_bitmaps(frame.repartition(5), scratch, params), "bitmaps")
            got = sorted(map(tuple, lines.kept_lines(frame, bitmaps).collect()))
            assert got == brute(rows, least_docs, keep_first, ids)
            for r in bitmaps.collect():
                assert lines.kept_bits(r.keep, r.n_lines).sum() == r.n_lines - r.n_dropped
            assert lines.line_bitmaps(frame.limit(0), scratch, params).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_small_bitmaps_move_no_text(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    with Scratch(spark) as scratch:
        frame = scratch.table(frame, "docs")
        bitmaps = scratch.table(lines.line_bitmaps(frame, scratch), "bitmaps")
        plan = lines.kept_lines(frame, bitmaps)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
