"""Scoring of whole frames, batch or stream, with a fitted pipeline."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import TEXT_COLUMN
from ..functions.text import is_blank, quoted
from ..operators.features import PREDICTED, PROBABILITY, TERMS, TEXT
from ..sources.store import append_predictions, log_rows


def classes_of(model: PipelineModel) -> list[str]:
    """The labels a pipeline can predict, in the order of its probabilities."""
    last = model.stages[-1]
    if not isinstance(last, IndexToString):
        raise ValueError("not a pipeline made by train()")
    return list(last.getLabels())


def score(
    model: PipelineModel,
    df: DataFrame,
    text_col: str = TEXT_COLUMN,
    probabilities: bool = False,
    on_null: str = "keep",
) -> DataFrame:
    """`df` with `predicted_category`, `confidence` and, if asked, `probabilities`.

    All other columns pass through, and a column with the name of a result is replaced where it
    stands. A null text gives null results, or fails the
    job with `on_null='fail'`. One pass of the forest yields all columns; there is no shuffle, so
    the call works on a stream as it does on a table.
    """
    if on_null not in ("keep", "fail"):
        raise ValueError("on_null must be 'keep' or 'fail'")
    results = ("predicted_category", "confidence") + (("probabilities",) if probabilities else ())
    kept = [quoted(c) for c in df.columns if c not in results]
    text = quoted(text_col) if text_col in df.columns else F.col(text_col)
    if on_null == "fail":
        text = F.coalesce(text, F.raise_error(F.lit(f"null in column {text_col}")))
    source = df.select(*kept, text.alias(TEXT))
    known = F.col(TEXT).isNotNull()
    odds = vector_to_array(F.col(PROBABILITY))
    columns = {"predicted_category": F.col(PREDICTED), "confidence": F.array_max(odds)}
    if probabilities:
        columns["probabilities"] = F.map_from_arrays(F.lit(classes_of(model)), odds)
    columns = {name: F.when(known, value).alias(name) for name, value in columns.items()}
    placed = [columns.pop(c) if c in columns else quoted(c) for c in df.columns]
    return model.transform(source).select(*placed, *columns.values())


class TextScorer:
    """A fitted pipeline for one text at a time, on the driver and without a job.

    Words and pairs come from the pipeline's own expressions over a relation of one literal, which
    Spark evaluates while it plans. They are counted and weighted here as the vector stages do, and
    the forest's single-vector call gives the probabilities. Equal to `score` on the same text; for
    many texts `score` is the way, since this works through them one by one.
    """

    def __init__(self, model: PipelineModel):
        words, pairs, counter, weights, _, self._forest, _ = model.stages
        inner = "VALUES (CAST(:text AS STRING)) AS given(" + TEXT + ")"
        for stage in (words, pairs):
            inner = "(" + stage.getStatement().replace("__THIS__", inner) + ")"
        self._statement = f"SELECT {TERMS} FROM {inner}"
        self._index = {term: i for i, term in enumerate(counter.vocabulary)}
        self._weights = weights.getScalingVec().toArray().tolist()
        self._classes = classes_of(model)

    def terms(self, spark: SparkSession, text: str) -> list[str]:
        return spark.sql(self._statement, args={"text": text}).collect()[0][0]

    def vector(self, terms: Sequence[str]) -> SparseVector:
        counts = Counter(i for term in terms if (i := self._index.get(term)) is not None)
        weighted = {i: n * self._weights[i] for i, n in sorted(counts.items())}
        norm = math.sqrt(sum(w * w for w in weighted.values()))
        return Vectors.sparse(len(self._weights), {i: w / norm for i, w in weighted.items()})

    def __call__(self, spark: SparkSession, text: str) -> dict:
        odds = self._forest.predictProbability(self.vector(self.terms(spark, text))).toArray()
        best = int(odds.argmax())
        return {
            "category": self._classes[best],
            "confidence": float(odds[best]),
            "probabilities": dict(zip(self._classes, odds.tolist())),
        }


_scorers: WeakKeyDictionary[PipelineModel, TextScorer] = WeakKeyDictionary()


def predict(spark: SparkSession, model: PipelineModel, text: str) -> dict:
    """One text: category, confidence and the probability of each class. No job is run.

    The first call for a model reads its vocabulary and weights, later ones use them again.
    """
    if text is None:
        raise ValueError("the text is null")
    if model not in _scorers:
        _scorers[model] = TextScorer(model)
    return _scorers[model](spark, text)


def ranked_probabilities(scored: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """One row per text and class, the most probable first; equal ones by class name."""
    pairs = F.transform(
        F.map_entries("probabilities"),
        lambda e: F.struct((-e["value"]).alias("order"), e["key"].alias("category")),
    )
    return scored.select(*id_cols, F.posexplode(F.array_sort(pairs)).alias("_i", "_e")).select(
        *id_cols,
        (F.col("_i") + 1).alias("rank"),
        F.col("_e.category").alias("category"),
        (-F.col("_e.order")).alias("probability"),
    )


def without_blank(df: DataFrame, text_col: str) -> DataFrame:
    """Rows whose text is more than white space."""
    return df.where(~is_blank(text_col))


def scored_log_rows(
    model: PipelineModel,
    df: DataFrame,
    id_col: str,
    text_col: str = TEXT_COLUMN,
    version: str | None = None,
    timestamp_col: str | None = None,
) -> DataFrame:
    """Log rows for all texts that are more than white space."""
    scored = score(model, without_blank(df, text_col), text_col)
    return log_rows(scored, id_col, text_col, version, timestamp_col)


def score_and_log(
    model: PipelineModel,
    df: DataFrame,
    log_path: str,
    id_col: str,
    text_col: str = TEXT_COLUMN,
    version: str | None = None,
    timestamp_col: str | None = None,
    batch: str | None = None,
) -> None:
    """Score and append to the log as one job. Plain `score` logs nothing.

    With a name for the `batch` the call may be repeated, and its rows are in the log once.
    """
    rows = scored_log_rows(model, df, id_col, text_col, version, timestamp_col)
    append_predictions(rows, log_path, timestamp_col is not None, batch)
