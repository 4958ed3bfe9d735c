"""Language of texts by hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

UNKNOWN = "und"
# Scores of n-grams that one Python worker remembers.
REMEMBERED = 200_000
# Vectors that are multiplied at a time: 2 MB of signs, and as doubles eight times that.
_AT_ONCE = 1024
# A text is of no learned language if its trigrams agree with the nearest prototype by less than this
# share of what the language's own do, and by so many standard deviations of chance.
LEAST_SHARE, DEVIATIONS = 0.25, 4.0


@dataclass(frozen=True)
class LanguageParams:
    """Dimensions of the vectors and the seed of the letters' random signs."""

    dimensions: int = 2048
    seed: int = 7


@cache
def _letters() -> np.ndarray:
    """For every code point the lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.int64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(low) if len(low := c.lower()) == 1 else i
    return out


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of all texts, and how many each text has.

    A trigram is a letter with its two neighbours, where what is not a letter counts as 0: three
    numbers of 21 bits. Words do not run on from one text to the next.
    """
    whole = "\0".join(["", *(t or "" for t in texts), ""])
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    letters = _letters()[points]
    middle = np.flatnonzero(letters[1:-1]) + 1
    codes = (letters[middle - 1] << 42) | (letters[middle] << 21) | letters[middle + 1]
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    return codes, np.diff(np.searchsorted(middle, np.concatenate([[0], ends])))


class Vectors:
    """Vectors of trigrams: the letters' random signs, permuted by place and multiplied."""

    def __init__(self, params: LanguageParams):
        self._params = params
        self._letters: dict[int, np.ndarray] = {}

    def _letter(self, code: int) -> np.ndarray:
        if code not in self._letters:
            rng = np.random.default_rng([self._params.seed, code])
            self._letters[code] = rng.integers(0, 2, self._params.dimensions).astype(np.int8) * 2 - 1
        return self._letters[code]

    def of(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), self._params.dimensions), np.int8)
        mask = (1 << 21) - 1
        for row, code in zip(out, codes.tolist()):
            row[:] = np.roll(self._letter(code >> 42), 2)
            row *= np.roll(self._letter((code >> 21) & mask), 1)
            row *= self._letter(code & mask)
        return out


@dataclass(frozen=True)
class Profiles:
    """Unit prototypes, one row for each learned language.

    `typical` is the mean product of a language's trigrams with its own prototype.
    """

    languages: list[str]
    prototypes: np.ndarray
    params: LanguageParams
    typical: np.ndarray


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        langs = np.array(batch.column(1).to_pylist(), object)
        texts = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            codes, _ = grams(list(texts[langs == lang]))
            code, n = np.unique(codes, return_counts=True)
            yield pa.record_batch(
                [pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)],
                ["lang", "gram", "n"],
            )


def _bundle(params: LanguageParams):
    def run(group: pa.Table) -> pa.Table:
        vectors = Vectors(params)
        gram = group.column("gram").to_numpy()
        n = group.column("n").to_numpy().astype(np.float64)
        total = np.zeros(params.dimensions)
        for low in range(0, len(gram), _AT_ONCE):
            total += n[low : low + _AT_ONCE] @ vectors.of(gram[low : low + _AT_ONCE])
        return pa.table(
            {
                "lang": group.column("lang").slice(0, 1),
                "bundle": pa.array([total.tolist()]),
                "grams": pa.array([n.sum()]),
            }
        )

    return run


def learn(labelled: DataFrame, params: LanguageParams = LanguageParams()) -> Profiles:
    """Prototypes from the columns `text` and `lang`; rows with a null language are left out.

    Trigrams are counted over all rows; those of a language are bundled in 16 parts.
    """
    counts = (
        labelled.where("lang is not null and text is not null")
        .select("text", "lang")
        .mapInArrow(_gram_counts, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    parts = (
        counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(16)))
        .groupBy("lang", "part")
        .applyInArrow(_bundle(params), "lang string, bundle array<double>, grams double")
    )
    bundles: dict[str, np.ndarray] = {}
    sizes: dict[str, float] = {}
    # At most 16 rows a language, in an order that does not depend on the run.
    for row in sorted(parts.collect()):
        bundles[row["lang"]] = bundles.get(row["lang"], 0) + np.array(row["bundle"])
        sizes[row["lang"]] = sizes.get(row["lang"], 0) + row["grams"]
    languages = sorted(bundles)
    norms = [float(np.linalg.norm(bundles[x])) for x in languages]
    rows = [bundles[x] / (norm or 1) for x, norm in zip(languages, norms)]
    typical = np.array([norm / max(sizes[x], 1) for x, norm in zip(languages, norms)])
    return Profiles(languages, np.array(rows).reshape(len(rows), params.dimensions), params, typical)


class _Scorer:
    """Dot products of trigrams with all prototypes; those already met are remembered."""

    def __init__(self, profiles: Profiles):
        self._profiles, self._vectors = profiles, Vectors(profiles.params)
        self._codes = np.zeros(0, np.int64)
        self._rows = np.zeros((0, len(profiles.languages)))

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        distinct = np.unique(codes)
        new = distinct[~np.isin(distinct, self._codes, assume_unique=True)]
        if len(self._codes) + len(new) > REMEMBERED:
            self._codes, self._rows, new = self._codes[:0], self._rows[:0], distinct
        if len(new):
            rows = [
                self._vectors.of(new[a : a + _AT_ONCE]) @ self._profiles.prototypes.T
                for a in range(0, len(new), _AT_ONCE)
            ]
            merged = np.concatenate([self._codes, new])
            order = np.argsort(merged)
            self._codes = merged[order]
            self._rows = np.concatenate([self._rows, *rows])[order]
        return self._rows[np.searchsorted(self._codes, codes)]


def _nearest(scorer: _Scorer, texts: list[str | None], n_languages: int):
    """The number of each text's language, `n_languages` if it has none, and all dot products."""
    codes, sizes = grams(texts)
    dots = np.zeros((len(texts), n_languages))
    some = np.flatnonzero(sizes)
    if not n_languages or not len(some):
        return np.full(len(texts), n_languages), dots
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])[some]
    # A bundle's dot product is the sum of its n-grams' dot products.
    dots[some] = np.add.reduceat(scorer(codes), begin)
    return np.where(sizes > 0, dots.argmax(axis=1), n_languages), dots


def _predicted(profiles: Profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(profiles)
        names = np.array([*profiles.languages, UNKNOWN], object)
        for batch in slices(batches):
            best, dots = _nearest(scorer, batch.column(1).to_pylist(), len(profiles.languages))
            positive = np.maximum(dots, 0)
            top = np.append(positive, np.zeros((len(dots), 1)), axis=1)[np.arange(len(dots)), best]
            score = top / np.maximum(positive.sum(axis=1), 1e-300)
            yield pa.record_batch(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(score)],
                ["doc_id", "lang_pred", "score"],
            )

    return run


def identify(
    docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: `doc_id`, `lang_pred` and `score`.

    The language is that of the prototype with the largest cosine to the bundle of all the text's
    trigrams; of equal ones, the first by name. The score is its cosine as a share of the sum of all
    positive cosines, so the length of the bundle cancels out. Texts that are null or have no letter
    are `und` with score 0, and so is everything if no language was learned. Rows may repeat; other
    columns are not read; no rows give no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_predicted(profiles), "doc_id long, lang_pred string, score double")


def _foreign(codes: np.ndarray, dot: float, typical: float) -> bool:
    """Whether a text's trigrams agree with a prototype hardly more than random ones would.

    Products of random trigrams have mean 0 and deviation 1; repeats of one are no new evidence, so a
    text of few trigrams gets the benefit of the doubt.
    """
    if dot >= LEAST_SHARE * typical * len(codes):
        return False
    n = np.unique(codes, return_counts=True)[1].astype(float)
    independent = n.sum() ** 2 / (n @ n)
    return dot / len(codes) < LEAST_SHARE * typical - DEVIATIONS / np.sqrt(independent)


def known_only(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose text has a language that was learned.

    Null texts and texts without a letter go, and so do texts that agree with no prototype, as those of
    another script. If no language was learned, nothing is known against any row and all stay. Every
    row is judged by itself, and nothing is shuffled or joined.
    """
    n = len(profiles.languages)
    if not n:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(profiles)
        for batch in slices(batches, at):
            texts = batch.column(at).to_pylist()
            best, dots = _nearest(scorer, texts, n)
            keep = best < n
            for i in np.flatnonzero(keep):
                own, typical = dots[i, best[i]], profiles.typical[best[i]]
                # The count of trigrams is at most that of characters.
                if own < LEAST_SHARE * typical * len(texts[i]):
                    keep[i] = not _foreign(grams([texts[i]])[0], own, typical)
            yield batch.filter(pa.array(keep))
        pa.default_memory_pool().release_unused()

    # Names may have dots, which `mapInArrow` does not quote.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
