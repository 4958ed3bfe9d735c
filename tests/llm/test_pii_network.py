"""What the network adds: keys and tokens in other forms than it was taught, and nothing else."""

import itertools
import random
import re

import numpy as np
import pytest

from sextile.llm import pii
from sextile.sources.shared import Scratch

DOCS = "/root/testdata/sf0.1/documents.parquet"
FORMS = (
    "the key is {} for now", "Authorization: Bearer {}", "password={} and", 'export API_KEY="{}"',
    "use {} to log in", "secret: '{}'",
)


@pytest.fixture(scope="module")
def learned(spark):
    with Scratch(spark) as scratch:
        return pii.learn(spark.read.parquet(DOCS), scratch)


def added(model, text):
    return pii.added_spans(text, pii._decoded(model, [text], 64)[0], pii.base_spans(text))


def test_keys_in_forms_that_were_not_taught(learned):
    rng = random.Random(3)
    letters = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = n = 0
    for i in range(240):
        key = "".join(rng.choice(letters if i % 2 else letters[:16]) for _ in range(rng.randrange(24, 48)))
        if pii._is_key(key):
            n += 1
            text = f"Words that stand here before it. {FORMS[i % 6].format(key)} and more words follow."
            found += any(k == "secret" and key in text[a:b] for k, a, b in added(learned, text))
    assert n > 200 and found >= 0.9 * n


def test_no_false_spans_in_documents(spark, learned):
    docs = spark.read.parquet(DOCS)
    rows = docs.join(pii.find(docs, learned), "doc_id").select("text", "base", "added").collect()
    right = wrong = all_keys = 0
    for r in rows:
        keys = {m.span(1) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text or "")}
        all_keys += len(keys)
        for s in r.added:
            right += (s.start, s.end) in keys
            wrong += (s.start, s.end) not in keys
        assert [tuple(s) for s in r.base] == pii.base_spans(r.text)
    assert all_keys > 100 and right >= 0.95 * all_keys and wrong <= 0.02 * all_keys


def test_odd_texts(learned):
    for text in ("", "a1" * 30_000, "1" * 50_000, "a1b2-" * 4 + " " + "x@" * 20_000, "token = \"" + "é1" * 30):
        spans = added(learned, text)
        assert all(a[2] <= b[1] for a, b in itertools.pairwise(spans))


def test_decode_is_the_best_path():
    rng = np.random.default_rng(2)
    model = pii.BiLstmCrf(pii.PiiParams(hidden=2))
    for name in ("emit", "moves"):
        model.weights[name] = rng.normal(0, 2, model.weights[name].shape)
    x = rng.integers(0, pii.N_CLASSES, (3, 5))
    scores, _ = model.emissions(x)
    moves = model.weights["moves"]
    got = model.decode(x)
    for j in range(5):
        def value(path):
            return sum(scores[t, j, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path))
        best = max(itertools.product(range(pii.N_TAGS), repeat=3), key=value)
        assert value(tuple(got[:, j])) == pytest.approx(value(best))
