"""Term counts, vocabulary and weights against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_text import python_terms, python_tokens

from sextile.functions.text import tokens
from sextile.operators import features
from sextile.operators import vocabulary as module
from sextile.operators.features import tfidf_entries, tfidf_vectors
from sextile.operators.vocabulary import (
    build_vocabulary,
    count_terms,
    frequent_pairs,
    occurrences,
    term_counts,
)


def corpus(n=60, seed=7):
    """Zipf-like words; one word is in every text and so falls to the upper limit."""
    chance = random.Random(seed)
    names = [f"w{i:02d}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    texts = ["everywhere " + " ".join(chance.choices(names, weights, k=12)) for _ in range(n)]
    return texts + ["", "everywhere"]


def by_hand(texts, max_features, min_df=2, max_df=0.95):
    tf, df = Counter(), Counter()
    for text in texts:
        listed = python_terms(text)
        tf.update(listed)
        df.update(set(listed))
    kept = [t for t in tf if min_df <= df[t] <= max_df * len(texts)]
    kept.sort(key=lambda t: (-tf[t], t))
    return {t: (tf[t], df[t]) for t in kept[:max_features]}


def documents(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return frame.repartition(5).withColumn("words", tokens("text"))


@pytest.mark.parametrize("max_features", [1, 5, 20, 37, 60, 10_000])
@pytest.mark.parametrize("pair_buckets", [1, 1 << 20])
def test_vocabulary(spark, monkeypatch, max_features, pair_buckets):
    """The sketch of pairs changes nothing, be it so small that pairs collide or ample."""
    monkeypatch.setattr(
        module, "term_counts", lambda *given: term_counts(*given, pair_buckets=pair_buckets)
    )
    texts = corpus()
    docs = documents(spark, texts)
    got = build_vocabulary(docs, "words", len(texts), max_features=max_features)
    expected = by_hand(texts, max_features)
    assert got.terms == sorted(expected)
    assert [(a, b) for a, b in zip(got.term_counts, got.doc_counts)] == [
        expected[t] for t in got.terms
    ]


def test_pairs_of_rare_words_are_left_out_early(spark):
    texts = corpus()
    docs = documents(spark, texts)
    some = term_counts(docs, "words", len(texts), max_features=5).count()
    every = term_counts(docs, "words", len(texts), max_features=None).count()
    assert some < every == len(by_hand(texts, None))


@pytest.mark.parametrize("pair_buckets", [64, 1 << 12])
def test_pairs_are_bounded_before_they_are_shuffled(spark, pair_buckets):
    """Of nearly 40,000 distinct pairs some hundred numbers and the frequent pairs are shuffled."""
    chance = random.Random(3)
    names = [f"r{i}" for i in range(2000)]
    texts = [" ".join([*chance.choices(names, k=20), "often met"]) for _ in range(2000)]
    docs = documents(spark, texts)
    tf = Counter(t for text in texts for t in python_terms(text))
    counted = count_terms(occurrences(docs, frequent_pairs(docs, "words", 900, 44_000, pair_buckets)))
    got = {r.term: r.tf for r in counted.collect()}
    assert all(tf[t] == n for t, n in got.items())
    assert got.keys() >= {t for t in tf if " " in t and tf[t] >= 900} == {"often met"}
    # A bucket of 64 holds some 650 other pairs; finer ones hardly any.
    assert len(got) < (len(tf) - 2002) / (15 if pair_buckets == 64 else 100)


def test_frequent_pairs_of_odd_rows(spark):
    rows = [(None,), ([],), (["a"],), (["a", "b"],), (["a", "b", "a", "b"],), (["\u00e9'", "\\"],)]
    frame = spark.createDataFrame(rows, "w array<string>")
    for least, expected in ((1, {"a b": 3, "b a": 1, "\u00e9' \\": 1}), (3, {"a b": 3}), (9, {})):
        got = count_terms(occurrences(frame, frequent_pairs(frame, "w", least, 9))).collect()
        assert {r.term: r.tf for r in got if r.tf >= least} == expected


def test_counts_of_a_hot_term(spark):
    frame = spark.createDataFrame([(["a"] * 1000 + ["b"],), (["a"],), ([],)], "w array<string>")
    rows = {r.term: (r.tf, r.df) for r in count_terms(occurrences(frame, "w")).collect()}
    assert rows == {"a": (1001, 2), "b": (1, 1)}


def test_no_terms(spark):
    with pytest.raises(ValueError, match="no term"):
        build_vocabulary(documents(spark, ["the", "and"]), "words", 2)


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_weights(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(features, "BROADCAST_ROWS", broadcast_rows)
    texts = corpus()
    docs = documents(spark, texts)
    vocabulary = build_vocabulary(docs, "words", len(texts), max_features=30)
    weights = dict(zip(vocabulary.terms, vocabulary.idf))
    scored = texts + ["unknown only", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(scored)], "id long, text string")
    vectors = tfidf_vectors(frame, vocabulary, "text")
    assert vectors.columns == ["id", "text", "features"] and vectors.count() == len(scored)
    got = {(r.id, r.term): r.weight for r in tfidf_entries(vectors, vocabulary, "id").collect()}
    expected = {}
    for i, text in enumerate(scored):
        counts = Counter(t for t in python_terms(text or "") if t in weights)
        norm = math.sqrt(sum((n * weights[t]) ** 2 for t, n in counts.items()))
        expected.update({(i, t): n * weights[t] / norm for t, n in counts.items()})
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-12 for k in got)
    norms = tfidf_entries(vectors, vocabulary, "id").groupBy("id").agg(
        F.sum(F.col("weight") ** 2).alias("n")
    )
    assert norms.where("abs(n - 1) > 1e-9").count() == 0


def test_weight_formula():
    v = module.Vocabulary(["a"], [5], [3], 9)
    assert v.idf == [math.log(10 / 4) + 1]
    assert python_tokens("A b_1 the x") == ["b_1"]
