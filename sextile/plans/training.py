"""Training: labelled articles to a fitted pipeline and its evaluation."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import IndexToString
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import (
    ARTICLE_COLUMNS,
    CATEGORIES,
    ENGLISH_STOP_WORDS,
    MAX_DEPTH,
    MAX_DF,
    MAX_FEATURES,
    MIN_DF,
    MIN_LEAF,
    NUM_TREES,
    SEED,
)
from ..functions.text import has_text, joined_text
from ..operators import features as f
from ..operators import metrics
from ..operators.split import stratified_split
from ..operators.vocabulary import build_vocabulary
from ..sources.bundle import save_model
from ..sources.csv import require_columns
from ..sources.shared import Scratch
from ..sources.store import append_model

MODEL_TYPE = "Random Forest"
FRAMEWORK = "Spark ML"


# The least number of partitions that a forest is fitted on.
FIT_PARTITIONS = 8

# The bytes of a partition's binned rows, which a task reads at every pass of the fit, and the most where
# there would be more than MANY_PARTITIONS: each partition ships statistics of all nodes at every pass.
FIT_BYTES, MOST_FIT_BYTES = 128 << 20, 1 << 30
MANY_PARTITIONS = 4096


# The number of a row's share.
SHARE = "share"


@dataclass(frozen=True)
class ForestParams:
    """Settings of features and forest.

    `fit_partitions` fixes the placement of rows, on which the forest depends as it does on the
    seed. The default follows from the data alone: a partition's binned rows, 4 bytes per term,
    take 128 MB (more, but 1 GB at most, beyond MANY_PARTITIONS), and there are FIT_PARTITIONS at least.
    So the model does not depend on the cluster it is fitted on. `max_bins` bounds the candidate
    thresholds of a term.
    `max_memory_mb` bounds, per task, the statistics of the tree nodes that one pass over the
    rows splits together: more memory, fewer passes.
    `max_fit_rows` bounds the labelled rows that the forest is fitted on, drawn with exact shares of
    the classes; vocabulary and evaluation see all rows. There is no bound by default.
    `share_rows` bounds the rows of one fit instead, and uses them all: the trees are dealt out to as
    many disjoint shares of the rows as that takes, and make one forest. There is one share by default.
    """

    num_trees: int = NUM_TREES
    max_depth: int = MAX_DEPTH
    min_leaf: int = MIN_LEAF
    max_bins: int = 32
    max_features: int = MAX_FEATURES
    min_df: int = MIN_DF
    max_df: float = MAX_DF
    seed: int = SEED
    test_percent: int = 20
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS
    fit_partitions: int | None = None
    max_memory_mb: int = 256
    max_fit_rows: int | None = None
    share_rows: int | None = None


@dataclass(frozen=True)
class TrainedModel:
    model: PipelineModel
    metadata: dict
    test_counts: DataFrame = field(repr=False)


def prepared_articles(
    articles: DataFrame,
    id_col: str,
    text_cols: Sequence[str] = ARTICLE_COLUMNS[:3],
    label_col: str = ARTICLE_COLUMNS[3],
    text_col: str = "prepared_text",
) -> DataFrame:
    """Key, label and joined text of the articles that have any text."""
    return articles.where(has_text(*text_cols)).select(
        id_col, label_col, joined_text(*text_cols).alias(text_col)
    )


def train(
    articles: DataFrame,
    id_col: str,
    text_cols: Sequence[str] = ARTICLE_COLUMNS[:3],
    label_col: str = ARTICLE_COLUMNS[3],
    categories: Sequence[str] = CATEGORIES,
    params: ForestParams = ForestParams(),
    progress: Callable[[str], None] = lambda message: None,
) -> TrainedModel:
    """Split, fit and evaluate.

    `articles` needs a unique key that is the same at every read (see `sources.csv.land`). Their
    texts are read once: the words of each are written to the shared folder for the length of the
    job, and the split, the vocabulary, the vectors and the test all start from that table. What
    reaches the driver has a bound: classes, vocabulary, model and the small count tables.
    """
    started = time.monotonic()
    require_columns(articles, [id_col, *text_cols, label_col])
    progress("preparing data")
    with Scratch(articles.sparkSession) as scratch:
        prepared = prepared_articles(articles, id_col, text_cols, label_col, f.TEXT)
        words = f.token_stage(params.stop_words).transform(prepared)
        words = scratch.table(words.select(id_col, label_col, f.TOKENS), "words")
        split = stratified_split(words, id_col, label_col, params.test_percent, params.seed)
        train_words = split.rows.where("split = 'train'")
        test_words = split.rows.where("split = 'test'")
        progress(f"split: {split.n_train} train, {split.n_test} test")

        progress("building the vocabulary")
        vocabulary = build_vocabulary(
            train_words, f.TOKENS, split.n_train, params.min_df, params.max_df, params.max_features
        )
        progress("training the forest")
        to_vectors = f.vector_stages(vocabulary)
        fit_words, n_fit = train_words, split.n_train
        if params.max_fit_rows and n_fit > params.max_fit_rows:
            fit_words, n_fit = _drawn(train_words, id_col, label_col, params)
        labelled = f.label_indexer(split.classes, label_col).transform(fit_words)
        vectors = PipelineModel(to_vectors).transform(labelled)
        shares = [n_fit]
        if params.share_rows and n_fit > params.share_rows:
            vectors, shares = _shared_out(vectors, id_col, params, n_fit, scratch)
        partitions = params.fit_partitions or fit_partitions(max(shares), len(vocabulary.terms))
        if len(shares) == 1:
            forest = fit_forest(vectors, id_col, params, partitions)
        else:
            forest = fit_shares(vectors, id_col, params, partitions, len(shares))
        to_label = IndexToString(inputCol=f.INDEX, outputCol=f.PREDICTED, labels=split.classes)
        model = PipelineModel([f.token_stage(params.stop_words), *to_vectors, forest, to_label])

        progress("evaluating")
        from_words = PipelineModel([*to_vectors, forest, to_label])
        pairs = from_words.transform(test_words).select(
            F.col(label_col).alias("y_true"), F.col(f.PREDICTED).alias("y_pred")
        )
        counts = local_counts(pairs)
    metadata = run_metadata(
        counts,
        n_samples=split.n_samples,
        n_train=split.n_train,
        categories=categories,
        training_time=time.monotonic() - started,
    )
    metadata |= {"n_fit": n_fit, "n_nodes": forest.totalNumNodes, "fit_partitions": partitions}
    metadata |= {"n_trees": forest.getNumTrees, "fit_shares": shares}
    progress("done")
    return TrainedModel(model, metadata, counts)


def train_and_register(
    articles: DataFrame, id_col: str, models: str, name: str, registry: str, **settings
) -> TrainedModel:
    """Train, store the model under its name and append the run to the registry."""
    trained = train(articles, id_col, **settings)
    save_model(articles.sparkSession, trained.model, trained.metadata, models, name)
    append_model(articles.sparkSession, registry, trained.metadata)
    return trained


def _drawn(rows: DataFrame, id_col: str, label_col: str, params: ForestParams):
    """The rows to fit on where their number has a bound, and how many they are."""
    drawn = stratified_split(
        rows.drop("split"), id_col, label_col, seed=params.seed, n_train=params.max_fit_rows
    )
    none = sorted(label for label, n in drawn.train_quotas.items() if not n)
    if none:
        raise ValueError(f"max_fit_rows leaves no row of {', '.join(none)}")
    return drawn.rows.where("split = 'train'"), drawn.n_train


def _shared_out(
    vectors: DataFrame, id_col: str, params: ForestParams, n_rows: int, scratch: Scratch
) -> tuple[DataFrame, list[int]]:
    """The vectors in a table with a partition for each share, and how many rows each has.

    Shares are dealt by hash of the key, so classes keep their proportions. They are counted, and made
    smaller until the largest is within the bound. One shuffle of vectors, none of texts.
    """
    key = F.xxhash64(F.lit(params.seed), F.col(id_col).cast("string"))
    n = -(-n_rows // params.share_rows)
    while True:
        place = F.pmod(key, F.lit(n)).cast("int").alias(SHARE)
        sizes = [r["count"] for r in vectors.groupBy(place).count().collect()]
        if max(sizes) <= params.share_rows:
            break
        n += max(1, n // 16)
    if n > params.num_trees:
        raise ValueError(f"share_rows asks for {n} shares, and there are {params.num_trees} trees")
    rows = vectors.select(id_col, f.LABEL_INDEX, f.FEATURES, place)
    path = scratch.path("shares")
    rows.hint("rebalance", SHARE).write.partitionBy(SHARE).parquet(path)
    return vectors.sparkSession.read.schema(rows.schema).parquet(path), sizes


def fit_shares(
    vectors: DataFrame, id_col: str, params: ForestParams, partitions: int, n: int
) -> RandomForestClassificationModel:
    """One forest of trees that were fitted on a share of the rows each, one share after the other.

    Trees vote with their leaf's class shares, so the probabilities are the mean over all trees, as in
    any forest; scoring, storing and single texts know no difference.
    """
    jvm = vectors.sparkSession._jvm
    trees, forests = [], []
    for i in range(n):
        own = replace(
            params, seed=params.seed + i, num_trees=params.num_trees // n + (i < params.num_trees % n)
        )
        forests.append(fit_forest(vectors.where(F.col(SHARE) == i), id_col, own, partitions))
        trees += list(forests[-1]._java_obj.trees())
    first = forests[0]
    # PySpark has no call that joins forests; the model of the JVM is made of its trees.
    kind = jvm.org.apache.spark.ml.classification
    array = vectors.sparkSession.sparkContext._gateway.new_array(
        kind.DecisionTreeClassificationModel, len(trees)
    )
    for i, tree in enumerate(trees):
        array[i] = tree
    joined = kind.RandomForestClassificationModel(first.uid, array, first.numFeatures, first.numClasses)
    first._java_obj.copyValues(joined, first._java_obj.extractParamMap())
    joined.set(joined.numTrees(), len(trees))
    return RandomForestClassificationModel(joined)


def fit_partitions(n_rows: int, n_terms: int) -> int:
    """Partitions for the fit, from the data alone: a few, more once one would be over FIT_BYTES."""
    size = n_rows * n_terms * 4
    wanted = min(-(-size // FIT_BYTES), MANY_PARTITIONS)
    return max(FIT_PARTITIONS, wanted, -(-size // MOST_FIT_BYTES))


def fit_forest(
    vectors: DataFrame, id_col: str, params: ForestParams, partitions: int
) -> RandomForestClassificationModel:
    """Fit on rows that lie in the same places at every run.

    Vectors are small beside the texts, so the shuffle by key is cheap, and it evens out tasks.
    The vectors are kept for the several passes of the fit.
    """
    placed = (
        vectors.select(id_col, f.LABEL_INDEX, f.FEATURES)
        .repartition(partitions, id_col)
        .sortWithinPartitions(id_col)
        .select(f.LABEL_INDEX, f.FEATURES)
        .persist()
    )
    forest = RandomForestClassifier(
        labelCol=f.LABEL_INDEX,
        featuresCol=f.FEATURES,
        predictionCol=f.INDEX,
        probabilityCol=f.PROBABILITY,
        rawPredictionCol=f.RAW,
        numTrees=params.num_trees,
        maxDepth=params.max_depth,
        minInstancesPerNode=params.min_leaf,
        maxBins=params.max_bins,
        featureSubsetStrategy="sqrt",
        impurity="gini",
        seed=params.seed,
        maxMemoryInMB=params.max_memory_mb,
        # Rows walk down from the root at every pass. If they remembered their node, each pass would read
        # all binned rows twice, and once more for every pass that it has to catch up on where a block is lost.
        cacheNodeIds=False,
    )
    try:
        return forest.fit(placed)
    finally:
        placed.unpersist()


def local_counts(pairs: DataFrame) -> DataFrame:
    """Confusion counts, computed once: at most one row per pair of the model's classes."""
    counts = metrics.confusion_counts(pairs)
    return pairs.sparkSession.createDataFrame(counts.collect(), counts.schema)


def run_metadata(
    counts: DataFrame,
    n_samples: int,
    n_train: int,
    categories: Sequence[str] = CATEGORIES,
    model_type: str = MODEL_TYPE,
    framework: str = FRAMEWORK,
    training_time: float | None = None,
    trained_date: datetime | None = None,
) -> dict:
    """The record of a run, from its confusion counts on the test part."""
    report = metrics.class_report(counts)
    overall = metrics.run_metrics(counts).first()
    wide = metrics.confusion_wide(counts, categories).collect()
    return {
        "model_type": model_type,
        "accuracy": overall["accuracy"],
        "f1_score": overall["f1_score"],
        "precision": overall["precision"],
        "recall": overall["recall"],
        "trained_date": (trained_date or datetime.now(timezone.utc)).isoformat(),
        "training_time": training_time,
        "n_samples": n_samples,
        "n_train": n_train,
        "n_test": overall["n_rows"],
        "categories": list(categories),
        "framework": framework,
        "category_metrics": {
            row["category"]: {
                "precision": row["precision"],
                "recall": row["recall"],
                "f1-score": row["f1_score"],
                "support": row["support"],
            }
            for row in metrics.category_report(report, categories).collect()
        },
        "confusion_matrix": {
            "matrix": [[row[c] for c in categories] for row in wide],
            "labels": list(categories),
        },
    }
