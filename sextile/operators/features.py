"""Feature stages: text to unit-length TF-IDF vectors, as savable pipeline stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    SQLTransformer,
    StringIndexerModel,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ENGLISH_STOP_WORDS
from ..functions.text import terms_sql, tokens_sql
from ..sources.shared import BROADCAST_ROWS
from .vocabulary import Vocabulary

# Names of the working columns inside a pipeline; results never carry them.
TEXT = "_sx_text"
TOKENS = "_sx_tokens"
TERMS = "_sx_terms"
COUNTS = "_sx_counts"
WEIGHTED = "_sx_weighted"
FEATURES = "_sx_features"
LABEL_INDEX = "_sx_label"
RAW = "_sx_raw"
PROBABILITY = "_sx_probability"
INDEX = "_sx_index"
PREDICTED = "_sx_predicted"


def token_stage(stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Transformer:
    """Text to words. A null text has no words and is not an error."""
    return SQLTransformer(
        statement=f"SELECT *, {tokens_sql(TEXT, stop_words)} AS {TOKENS} FROM __THIS__"
    )


def term_stage() -> Transformer:
    """Words to words and pairs."""
    return SQLTransformer(statement=f"SELECT *, {terms_sql(TOKENS)} AS {TERMS} FROM __THIS__")


def vector_stages(vocabulary: Vocabulary) -> list[Transformer]:
    """Words to weighted unit vectors; unknown terms are ignored and a zero vector stays zero."""
    return [
        term_stage(),
        CountVectorizerModel.from_vocabulary(vocabulary.terms, inputCol=TERMS, outputCol=COUNTS),
        ElementwiseProduct(
            scalingVec=Vectors.dense(vocabulary.idf), inputCol=COUNTS, outputCol=WEIGHTED
        ),
        Normalizer(p=2.0, inputCol=WEIGHTED, outputCol=FEATURES),
    ]


def label_indexer(classes: Sequence[str], label_col: str) -> StringIndexerModel:
    """Classes in ascending order become 0, 1, 2, ...; an unknown label is an error."""
    return StringIndexerModel.from_labels(
        sorted(classes), inputCol=label_col, outputCol=LABEL_INDEX, handleInvalid="error"
    )


def tfidf_vectors(
    df: DataFrame,
    vocabulary: Vocabulary,
    text_col: str,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """`df` with its feature vectors in column `features`. No shuffle."""
    stages = PipelineModel([token_stage(stop_words), *vector_stages(vocabulary)])
    vectors = stages.transform(df.withColumn(TEXT, F.col(text_col)))
    return vectors.select(*df.columns, F.col(FEATURES).alias("features"))


def token_vectors(df: DataFrame, vocabulary: Vocabulary, tokens_col: str) -> DataFrame:
    """The same from words that were made before, as a table of them has it."""
    vectors = PipelineModel(vector_stages(vocabulary)).transform(df.withColumn(TOKENS, F.col(tokens_col)))
    return vectors.select(*df.columns, F.col(FEATURES).alias("features"))


def tfidf_entries(vectors: DataFrame, vocabulary: Vocabulary, id_col: str) -> DataFrame:
    """The non-zero entries of sparse feature vectors: one row per document and term."""
    spark = vectors.sparkSession
    names = spark.createDataFrame(list(enumerate(vocabulary.terms)), "_index int, term string")
    if len(vocabulary.terms) <= BROADCAST_ROWS:
        names = F.broadcast(names)
    sparse = F.unwrap_udt("features")
    entry = F.arrays_zip(sparse["indices"].alias("_index"), sparse["values"].alias("weight"))
    return (
        vectors.select(id_col, F.explode(entry).alias("_e"))
        .select(id_col, "_e._index", "_e.weight")
        .join(names, "_index")
        .select(id_col, "term", "weight")
    )
