"""Term statistics and the bounded vocabulary of words and word pairs."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import MAX_DF, MAX_FEATURES, MIN_DF
from ..functions.text import bigrams, neighbours_sql
from ..sources.shared import Scratch

# Most buckets of the sketch of pair counts: one long each for a map task, one bit each for a plan.
PAIR_BUCKETS = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """At most `max_features` terms in ascending order, with their weights."""

    terms: list[str]
    term_counts: list[int]
    doc_counts: list[int]
    n_docs: int

    @property
    def idf(self) -> list[float]:
        return [math.log((1 + self.n_docs) / (1 + df)) + 1 for df in self.doc_counts]


def occurrences(docs: DataFrame, terms: Column | str) -> DataFrame:
    """One row per occurrence of a term; `first` is 1 once per document and 0 for its repeats.

    A row's terms are sorted, so that the first of equal neighbours stands for the document.
    """
    ordered = docs.select(F.sort_array(terms).alias("_terms"))
    marked = F.transform(
        "_terms",
        lambda term, i: F.struct(
            term.alias("term"),
            F.when((i > 0) & (F.get("_terms", i - 1) == term), 0).otherwise(1).alias("first"),
        ),
    )
    return ordered.select(F.explode(marked).alias("_t")).select("_t.*")


def count_terms(each: DataFrame) -> DataFrame:
    """Occurrences and number of documents per term, in one shuffle.

    There is no grouping by (document, term), and a frequent term leaves each map task as one
    partial sum.
    """
    return each.groupBy("term").agg(
        F.count(F.lit(1)).alias("tf"), F.sum("first").alias("df")
    )


def term_counts(
    docs: DataFrame,
    tokens: str,
    n_docs: int,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_features: int | None = MAX_FEATURES,
    save: Callable[[DataFrame, str], DataFrame] = lambda counts, name: counts,
    pair_buckets: int = PAIR_BUCKETS,
) -> DataFrame:
    """Counts of all words and pairs that can be among the `max_features` most frequent.

    Once `max_features` admissible words occur at least t times, no pair that occurs less often can
    enter the vocabulary. Pairs are counted by bucket of their hash first (`frequent_pairs`), which
    never counts a pair too low, so that those of light buckets are left out before any string is
    made, sorted or shuffled. That is exact for any number of buckets. With `max_features=None`
    nothing is left out. The word counts are read several times; `save` may write them once.
    """
    admissible = (F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n_docs))
    words = count_terms(occurrences(docs, tokens))
    pairs = bigrams(tokens)
    if max_features is not None:
        words = save(words, "word-counts")
        top = words.where(admissible).select("tf").orderBy(F.desc("tf")).limit(max_features)
        found, least = top.agg(F.count(F.lit(1)), F.min("tf")).first()
        if found == max_features:
            n_words = words.agg(F.sum("tf")).first()[0]
            pairs = frequent_pairs(docs, tokens, least, n_words, pair_buckets)
    return words.unionByName(count_terms(occurrences(docs, pairs))).where(admissible)


def frequent_pairs(
    docs: DataFrame, tokens: str, least: int, n_words: int, pair_buckets: int = PAIR_BUCKETS
) -> Column:
    """The pairs of a row that may occur `least` times or more in all rows, with their repeats.

    A count by bucket is at least that of each pair in it: a count-min sketch of one line. It has
    so many buckets that their mean is a quarter of `least`, but `pair_buckets` at most, so a map
    task holds and ships no more than that many numbers, however many distinct pairs there are.
    Word frequencies fall about as 1 / rank, so `n_words / least` hardly grows with the input. One bit
    for each bucket reaches the driver and, as a literal, the plan.
    """
    buckets = 64
    while buckets < min(pair_buckets, 4 * n_words / least):
        buckets *= 2
    bucket = f"(xxhash64(a, b) & {buckets - 1}L)"
    counted = (
        docs.select(F.explode(F.expr(neighbours_sql(tokens, bucket))).alias("bucket"))
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    )
    heavy = counted.where(F.col("n") >= least).groupBy(F.expr("bucket div 64").alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(bucket & 63L AS int)))").alias("bits")
    )
    bits = [0] * (buckets // 64)
    for row in heavy.collect():
        bits[row["at"]] = row["bits"]
    listed = f"CAST(split('{','.join(map(str, bits))}', ',') AS array<bigint>)"
    is_heavy = f"getbit({listed}[CAST({bucket} div 64 AS int)], CAST({bucket} & 63L AS int)) = 1"
    made = neighbours_sql(tokens, f"CASE WHEN {is_heavy} THEN concat(a, ' ', b) END")
    return F.expr(f"filter({made}, p -> p IS NOT NULL)")


def top_terms(counts: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """The most frequent terms; equally frequent ones in ascending order."""
    return counts.orderBy(F.desc("tf"), "term").limit(max_features)


def build_vocabulary(
    docs: DataFrame,
    tokens: str,
    n_docs: int,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_features: int = MAX_FEATURES,
) -> Vocabulary:
    """Bring the vocabulary, whose length has a bound, to the driver for the feature stages."""
    with Scratch(docs.sparkSession) as scratch:
        counts = term_counts(docs, tokens, n_docs, min_df, max_df, max_features, scratch.table)
        rows = sorted(top_terms(counts, max_features).collect())
    if not rows:
        raise ValueError("no term is left: the texts are empty or hold only stop words")
    terms, tf, df = (list(column) for column in zip(*rows))
    return Vocabulary(terms, tf, df, n_docs)


def weighted(counts: DataFrame, n_docs: int) -> DataFrame:
    """Adds the smoothed inverse document frequency of each term."""
    return counts.withColumn("idf", F.log(F.lit(1.0 + n_docs) / (F.col("df") + 1.0)) + 1.0)
