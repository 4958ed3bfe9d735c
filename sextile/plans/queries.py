"""The registered queries: each runs one or more operators over whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import ARTICLE_COLUMNS, DESCRIPTION, HEADLINE, LABEL, TAGS
from ..functions.text import has_text, terms, tokens
from ..functions.times import instant
from ..operators import analytics, features, metrics, registry, vocabulary
from ..operators.split import Split, split_counts, stratified_split
from ..sources import bundle, catalog, csv, store
from ..sources.shared import materialize, new_path, spread, stored_bytes
from ..streaming import jobs
from . import rollup as stored
from . import scoring, training, views
from .views import ranked, rounded

Query = Callable[[SparkSession, str], DataFrame]

# A small forest, so that the queries which need a model stay quick.
SMALL = training.ForestParams(num_trees=20, max_depth=10)

# Blocks of the one CSV file: 8 tasks and more at the smallest scale.
CSV_BLOCK = 32 << 10

# Bytes of the given table for each CSV file, which one task writes.
CSV_FILE = 128 << 20

_models: dict[tuple[str, str], training.TrainedModel] = {}


def small_model(spark: SparkSession, sf_dir: str) -> training.TrainedModel:
    """The model of a data folder, fitted once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        labelled = spread(articles(spark, sf_dir), "article_id")
        _models[key] = training.train(labelled, "article_id", params=SMALL)
    return _models[key]


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled articles under the column names of a training file."""
    return views.labeled_articles(spark, sf_dir).select(
        "article_id",
        F.col("headline").alias(HEADLINE),
        F.col("description").alias(DESCRIPTION),
        F.col("topic_tags").alias(TAGS),
        F.col("category").alias(LABEL),
    )


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spread(articles(spark, sf_dir), "article_id")
    return training.prepared_articles(labelled, "article_id").withColumnRenamed(LABEL, "category")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(views.table(spark, sf_dir, "documents"), "doc_id")


def split(spark: SparkSession, sf_dir: str) -> Split:
    """The split needs keys and labels only, so the texts are read once and not at every pass."""
    keys = materialize(prepared(spark, sf_dir).select("article_id", "category"), "keys")
    return stratified_split(keys, "article_id", "category")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_counts(views.eval_pairs(spark, sf_dir))


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.daily_rollup(views.prediction_log(spark, sf_dir))


# --- prediction log ---------------------------------------------------------------------------


def prediction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = analytics.prediction_stats(rollup(spark, sf_dir))
    return ranked(rounded(table, ["avg_confidence"]))


def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.category_totals(rollup(spark, sf_dir))


def category_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = analytics.category_confidence(rollup(spark, sf_dir))
    return ranked(rounded(table, ["avg_confidence", "row_avg_confidence"]))


def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.daily_totals(rollup(spark, sf_dir))


def daily_category_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.daily_category_trend(rollup(spark, sf_dir))


def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = analytics.log_summary(rollup(spark, sf_dir))
    return rounded(table, ["avg_confidence", "row_avg_confidence"])


def recent_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = analytics.recent_predictions(views.prediction_log(spark, sf_dir))
    return rounded(table, ["confidence"])


def recent_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest predictions of a stored log, whose day partitions bound what is read."""
    log_path, _ = store.create_tables(spark, new_path(spark, "store"))
    rows = store.log_rows(views.prediction_log(spark, sf_dir), "id", timestamp_col="timestamp")
    store.append_predictions(rows, log_path, many_days=True)
    recent = analytics.recent_predictions(store.read_recent_log(spark, log_path, 20))
    utc = F.to_utc_timestamp("timestamp", F.current_timezone()).cast("timestamp_ntz")
    return rounded(recent.withColumn("timestamp", utc), ["confidence"])


def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = analytics.confidence_histogram(views.prediction_log(spark, sf_dir))
    return rounded(table, ["bin_start", "bin_end"])


def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.category_share(views.prediction_log(spark, sf_dir)), ["share"])


def predicted_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.value_counts(views.prediction_log(spark, sf_dir), "predicted_category")


def log_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written through the sink and read back."""
    log_path, _ = store.create_tables(spark, new_path(spark, "store"))
    rows = store.log_rows(
        views.prediction_log(spark, sf_dir), "id", version="Random Forest", timestamp_col="timestamp"
    )
    store.append_predictions(rows, log_path, many_days=True)
    columns = ["id", "text", "predicted_category", "confidence", "model_version", "date"]
    return rounded(store.read_log(spark, log_path).select(*columns), ["confidence"])


def rollup_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored daily figures of a log that grew: all days, then those of the second batch."""
    log_path, _ = store.create_tables(spark, new_path(spark, "store"))
    path = new_path(spark, "rollup")
    rows = store.log_rows(views.prediction_log(spark, sf_dir), "id", timestamp_col="timestamp")
    early = F.col("date") < F.lit("2024-01-16").cast("date")
    store.append_predictions(rows.where(early | (F.col("id") % 2 == 0)), log_path, many_days=True)
    stored.update_rollup(store.read_log(spark, log_path), path)
    late = rows.where(~early & (F.col("id") % 2 != 0))
    store.append_predictions(late, log_path, many_days=True)
    days = [row["date"] for row in late.select("date").distinct().collect()]
    stored.update_rollup(store.read_log(spark, log_path), path, days)
    table = analytics.prediction_stats(stored.read_rollup(spark, path))
    return ranked(rounded(table, ["avg_confidence"]))


def rollup_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily figures of a store that batches and a stream feed, one batch of them twice."""
    path = new_path(spark, "live")
    log = views.prediction_log(spark, sf_dir)
    instants = log.withColumn("timestamp", instant(log, "timestamp"))
    for number in (0, 1, 1):
        part = instants.where(F.pmod("id", F.lit(3)) == number)
        stored.add_batch(part, path, "backfill", number)
    stored.merge_batches(spark, path)
    stored.add_batch(instants.where(F.pmod("id", F.lit(3)) == 1), path, "backfill", 1)
    events = views.log_of(_source_stream(spark, sf_dir, "events"))
    jobs.stream_rollup(
        events.where(F.pmod("id", F.lit(3)) == 2), path, new_path(spark, "stream-checkpoint"), available_now=True
    ).awaitTermination()
    table = analytics.prediction_stats(analytics.rollup_of(stored.read_live(spark, path)))
    return ranked(rounded(table, ["avg_confidence"]))


def live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored state of all days of the log."""
    path = new_path(spark, "live")
    log = views.prediction_log(spark, sf_dir)
    stored.add_batch(log.withColumn("timestamp", instant(log, "timestamp")), path, "backfill", 0)
    return stored.read_live(spark, path)


SINCE, UNTIL = date(2024, 1, 10), date(2024, 1, 20)


def histogram_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence bins of a range of days, from the stored state alone."""
    days = analytics.between(live_state(spark, sf_dir), SINCE, UNTIL)
    return rounded(analytics.state_histogram(days), ["bin_start", "bin_end"])


def summary_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a range of days, from the stored state alone; texts are tested for their error."""
    days = analytics.between(live_state(spark, sf_dir), SINCE, UNTIL)
    return rounded(analytics.state_summary(days).drop("distinct_texts"), ["row_avg_confidence"])


def log_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log keeps of all documents, in four batches that are appended twice each."""
    log_path, _ = store.create_tables(spark, new_path(spark, "store"))
    rows = document_log(spark, sf_dir)
    for i in (0, 1, 0, 2, 3, 1, 2, 3):
        part = rows.where(F.pmod("id", F.lit(4)) == i)
        store.append_predictions(part, log_path, batch=f"part {i}")
    return store.read_log(spark, log_path).select(
        "id", "text", "predicted_category", "confidence", "model_version"
    )


def log_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in one log by batches and streams, with compactions between and after them."""
    log_path, _ = store.create_tables(spark, new_path(spark, "store"))
    model = small_model(spark, sf_dir).model
    part = F.pmod("doc_id", F.lit(4))
    checkpoint = new_path(spark, "stream-checkpoint")
    for i, batch in enumerate(("first", "second")):
        rows = documents(spark, sf_dir).where(part == i)
        scoring.score_and_log(model, rows, log_path, "doc_id", batch=batch)
        arriving = _source_stream(spark, sf_dir, "documents").where(part == 2 + i)
        jobs.stream_scores(
            model, arriving, log_path, f"{checkpoint}-{i}", "doc_id", available_now=True
        ).awaitTermination()
        store.compact_log(spark, log_path)
    store.expire_replaced(spark, log_path)
    # A batch that was merged is not taken twice.
    scoring.score_and_log(model, rows, log_path, "doc_id", batch="second")
    return store.read_log(spark, log_path).select("id", "text", "model_version")


def log_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of plain appends, a named batch and compactions, read through its catalog table."""
    log_path, _ = store.create_tables(spark, new_path(spark, "store"))
    table = "log_" + log_path.split("-")[-1].split("/")[0]
    rows = store.log_rows(
        views.prediction_log(spark, sf_dir), "id", version="Random Forest", timestamp_col="timestamp"
    )
    part = F.pmod("id", F.lit(3))
    store.append_predictions(rows.where(part == 0), log_path, many_days=True)
    catalog.publish_log(spark, log_path, table)
    store.append_predictions(rows.where(part == 1), log_path, many_days=True, batch="second")
    store.compact_log(spark, log_path)
    store.append_predictions(rows.where(part == 2), log_path, many_days=True)
    logged = catalog.publish_log(spark, log_path, table)
    columns = ["id", "text", "predicted_category", "confidence", "model_version", "date"]
    return rounded(logged.select(*columns), ["confidence"])


# --- labelled articles ------------------------------------------------------------------------


def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.value_counts(views.labeled_articles(spark, sf_dir), "category")


def dataset_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv.shape(articles(spark, sf_dir))


def dataset_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv.preview(articles(spark, sf_dir), "article_id")


def csv_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labelled articles written as CSV and read back with the checks of a training file."""
    path = new_path(spark, "articles-csv")
    csv.write_csv(articles(spark, sf_dir), path)
    return csv.read_labelled_articles(spark, path)


def csv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labelled articles as one multi-line CSV file, landed in many tasks; large tables are more files."""
    path = new_path(spark, "articles-csv")
    files = -(-stored_bytes(spark, f"{sf_dir}/documents.parquet") // CSV_FILE)
    csv.write_csv(articles(spark, sf_dir).coalesce(max(1, files)), path)
    landed = csv.land_csv(spark, path, new_path(spark, "articles"), block_bytes=CSV_BLOCK)
    return csv.require_columns(landed, ARTICLE_COLUMNS)


def csv_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversation turns written as CSV and read back as texts to score."""
    path = new_path(spark, "texts-csv")
    csv.write_csv(views.table(spark, sf_dir, "conversations"), path)
    return csv.read_texts(spark, path)


def prepared_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir)


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log would keep of every document that is more than white space."""
    kept = scoring.without_blank(views.table(spark, sf_dir, "documents"), "text")
    labelled = kept.select(
        "doc_id", "text", F.col("source").alias("predicted_category"), F.lit(0.5).alias("confidence")
    )
    return store.log_rows(labelled, "doc_id")


def log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_log(spark, sf_dir).select(
        "id", "text", "predicted_category", "confidence", "model_version"
    )


def stratified_split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).rows.select("article_id", "category", "split")


def split_counts_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_counts(split(spark, sf_dir).rows)


# --- features ---------------------------------------------------------------------------------


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select(
        "article_id", "category", tokens("prepared_text").alias("words")
    )


def token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select(
        "article_id", F.size("words").alias("n_tokens"), F.array_join("words", " ").alias("tokens")
    )


def term_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = words(spark, sf_dir).select("article_id", terms("words").alias("terms"))
    return listed.select(
        "article_id", F.size("terms").alias("n_terms"), F.array_join("terms", "|").alias("terms")
    )


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every word and pair that the document-frequency limits admit."""
    docs = materialize(words(spark, sf_dir).select("words"), "words")
    return vocabulary.term_counts(docs, "words", docs.count(), max_features=None)


def train_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, DataFrame]:
    """Words of the training part, how many articles it has, and the words of all articles."""
    every = materialize(words(spark, sf_dir), "words")
    parts = stratified_split(every, "article_id", "category")
    return parts.rows.where("split = 'train'"), parts.n_train, every


def vocabulary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n_docs, _ = train_words(spark, sf_dir)
    fitted = vocabulary.build_vocabulary(docs, "words", n_docs)
    rows = list(zip(fitted.terms, fitted.term_counts, fitted.doc_counts))
    top = spark.createDataFrame(rows, "term string, tf long, df long")
    return rounded(vocabulary.weighted(top, n_docs), ["idf"])


def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors of all articles, fitted on the training part, one row per entry."""
    docs, n_docs, every = train_words(spark, sf_dir)
    fitted = vocabulary.build_vocabulary(docs, "words", n_docs)
    vectors = features.token_vectors(every, fitted, "words")
    return rounded(features.tfidf_entries(vectors, fitted, "article_id"), ["weight"])


def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split(spark, sf_dir)
    indexed = features.label_indexer(parts.classes, "category").transform(parts.rows)
    return indexed.groupBy("category", F.col(features.LABEL_INDEX).cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- evaluation -------------------------------------------------------------------------------

METRICS = ["precision", "recall", "f1_score"]


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.accuracy(counts(spark, sf_dir)), ["accuracy"])


def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_report(counts(spark, sf_dir)), METRICS)


def weighted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = metrics.class_report(counts(spark, sf_dir))
    return rounded(metrics.weighted_metrics(report), METRICS)


def category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = metrics.class_report(counts(spark, sf_dir))
    return rounded(metrics.category_report(report), METRICS)


def category_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.category_report(metrics.class_report(counts(spark, sf_dir)), places=3)


def metric_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.metric_bars(metrics.class_report(counts(spark, sf_dir))), ["value"])


def confusion_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_cells(counts(spark, sf_dir))


def confusion_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_wide(counts(spark, sf_dir))


def test_record(spark: SparkSession, sf_dir: str) -> dict:
    """The run record of the rule that stands for a model, on the test part of the split."""
    parts = split(spark, sf_dir)
    test = parts.rows.where("split = 'test'").select("article_id")
    pairs = views.eval_pairs(spark, sf_dir).join(test, "article_id", "left_semi")
    return training.run_metadata(
        training.local_counts(pairs), parts.n_samples, parts.n_train, training_time=0.0
    )


def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = test_record(spark, sf_dir)
    scalars = ["model_type", "accuracy", "f1_score", "precision", "recall", "n_samples", "n_train"]
    scalars += ["n_test", "framework"]
    row = tuple(record[name] for name in scalars) + (", ".join(record["categories"]),)
    schema = (
        "model_type string, accuracy double, f1_score double, precision double, recall double,"
        " n_samples long, n_train long, n_test long, framework string, categories string"
    )
    return rounded(spark.createDataFrame([row], schema), ["accuracy", *METRICS])


def run_category_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = test_record(spark, sf_dir)["category_metrics"]
    rows = [
        (name, m["precision"], m["recall"], m["f1-score"], m["support"])
        for name, m in record.items()
    ]
    schema = "category string, precision double, recall double, f1_score double, support long"
    return rounded(spark.createDataFrame(rows, schema), METRICS)


def run_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = test_record(spark, sf_dir)["confusion_matrix"]
    rows = [
        (true, predicted, n)
        for true, line in zip(stored["labels"], stored["matrix"])
        for predicted, n in zip(stored["labels"], line)
    ]
    return spark.createDataFrame(rows, "y_true string, y_pred string, n long")


# --- registry ---------------------------------------------------------------------------------


def model_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = materialize(views.model_runs(spark, sf_dir), "runs")
    return ranked(rounded(registry.model_history(runs), ["accuracy", "f1_score"]))


def metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(registry.metric_series(views.model_runs(spark, sf_dir)), ["value"])


def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(registry.registry_summary(views.model_runs(spark, sf_dir)), ["best_accuracy"])


def registry_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry written through the sink and read back."""
    _, path = store.create_tables(spark, new_path(spark, "store"))
    store.append_runs(views.model_runs(spark, sf_dir), path)
    stored = registry.with_active(store.read_registry(spark, path)).select(
        "id", "model_name", "accuracy", "f1_score", "precision_score", "recall_score",
        F.to_date("trained_date").alias("trained_date"), "n_samples", "is_active",
    )
    return rounded(stored, ["accuracy", "f1_score", "precision_score", "recall_score"])


def registry_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run record appended to the registry as a training run does it, and read back."""
    _, path = store.create_tables(spark, new_path(spark, "store"))
    store.append_model(spark, path, test_record(spark, sf_dir))
    columns = ["model_name", "accuracy", "f1_score", "precision_score", "recall_score"]
    columns += ["n_samples", "n_train", "n_test", "framework", "is_active"]
    rows = registry.with_active(store.read_registry(spark, path)).select(*columns)
    return rounded(rows, columns[1:5])


# --- model ------------------------------------------------------------------------------------


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(views.table(spark, sf_dir, "conversations"), "conv_id", "turn")


def score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(small_model(spark, sf_dir).model, turns(spark, sf_dir))


def score_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = small_model(spark, sf_dir).model
    scored = scoring.score(model, turns(spark, sf_dir), probabilities=True)
    return scoring.ranked_probabilities(scored, ["conv_id", "turn"])


def score_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, keys and violations of what every scored table promises."""
    model = small_model(spark, sf_dir).model
    classes = scoring.classes_of(model)
    scored = scoring.score(model, documents(spark, sf_dir), probabilities=True)
    values = F.map_values("probabilities")
    total = F.aggregate(values, F.lit(0.0), lambda a, p: a + p)
    confidence, label = F.col("confidence"), F.col("predicted_category")
    broken = {
        "n_unknown_labels": label.isNull() | ~label.isin(*classes),
        "n_bad_confidence": ~confidence.between(1.0 / len(classes) - 1e-9, 1.0 + 1e-9),
        "n_bad_sums": F.abs(total - 1.0) > 1e-9,
        "n_not_largest": (F.array_max(values) != confidence)
        | (F.col("probabilities")[label] != confidence),
        "n_wrong_classes": ~F.array_sort(F.map_keys("probabilities")).eqNullSafe(F.lit(classes)),
    }
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("doc_id").alias("key_sum"),
        *[F.count_if(violated).alias(name) for name, violated in broken.items()],
    )


def score_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored into the log; the columns that do not depend on the forest."""
    log_path, _ = store.create_tables(spark, new_path(spark, "store"))
    model = small_model(spark, sf_dir).model
    scoring.score_and_log(model, documents(spark, sf_dir), log_path, "doc_id")
    return store.read_log(spark, log_path).select("id", "text", "model_version")


def score_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as CSV, read, scored, written as CSV and read back: input columns, and validity."""
    given, path = new_path(spark, "texts-csv"), new_path(spark, "scored-csv")
    csv.write_csv(views.table(spark, sf_dir, "conversations"), given)
    model = small_model(spark, sf_dir).model
    csv.write_csv(scoring.score(model, csv.read_texts(spark, given)), path)
    sure = F.col("confidence").cast("double")
    return csv.read_texts(spark, path).select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.coalesce(F.col("predicted_category").isin(*scoring.classes_of(model)), F.lit(False)).alias("known"),
        F.coalesce(sure.between(0.0, 1.0), F.lit(False)).alias("sure"),
    )


def bundle_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model stored and loaded again scores every document as before."""
    trained, root = small_model(spark, sf_dir), new_path(spark, "models")
    bundle.save_model(spark, trained.model, trained.metadata, root)
    model, metadata = bundle.load_model(spark, root)
    scores = [
        scoring.score(m, documents(spark, sf_dir)).select(
            "doc_id", F.struct("predicted_category", "confidence").alias(name)
        )
        for m, name in ((trained.model, "before"), (model, "after"))
    ]
    return scores[0].join(scores[1], "doc_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("before").eqNullSafe(F.col("after"))).alias("n_same"),
        F.lit(metadata == trained.metadata).alias("same_record"),
    )


def log_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in one log, by a batch, a stream, a second batch and a second stream."""
    log_path, _ = store.create_tables(spark, new_path(spark, "store"))
    model = small_model(spark, sf_dir).model
    part = F.pmod("doc_id", F.lit(4))
    for i in (0, 2):
        batch = documents(spark, sf_dir).where(part == i)
        scoring.score_and_log(model, batch, log_path, "doc_id")
        arriving = _source_stream(spark, sf_dir, "documents").where(part == i + 1)
        jobs.stream_scores(
            model, arriving, log_path, new_path(spark, "stream-checkpoint"), "doc_id", available_now=True
        ).awaitTermination()
    return store.read_log(spark, log_path).select("id", "text", "model_version")


def train_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, then the per-category report on the test part."""
    trained = small_model(spark, sf_dir)
    return metrics.category_report(metrics.class_report(trained.test_counts))


def train_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a training run says of its test part: the rows of each category."""
    report = metrics.class_report(small_model(spark, sf_dir).test_counts)
    return metrics.category_report(report).select("category", "support")


def share_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a forest of shares says of itself: rows fitted, those of all shares, and broken bounds."""
    rows = spread(articles(spark, sf_dir), "article_id")
    n = rows.where(has_text(*ARTICLE_COLUMNS[:3])).count()
    bound = -(-n // 3)
    trained = training.train(rows, "article_id", params=replace(SMALL, share_rows=bound))
    record = trained.metadata
    scored = scoring.score(trained.model, documents(spark, sf_dir), probabilities=True)
    odds = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, p: a + p)
    return scored.agg(
        F.lit(record["n_train"]).cast("long").alias("n_train"),
        F.lit(sum(record["fit_shares"])).cast("long").alias("n_fitted"),
        F.lit(sum(x > bound for x in record["fit_shares"])).cast("long").alias("n_over"),
        F.lit(record["n_trees"] - SMALL.num_trees).cast("long").alias("n_trees_off"),
        F.count_if(F.col("text").isNotNull()).alias("n_scored"),
        F.count_if(F.abs(odds - 1.0) >= 1e-9).alias("n_bad"),
    )


def rank_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, rows and violations of the ranked probabilities of all turns."""
    classes = scoring.classes_of(small_model(spark, sf_dir).model)
    lists = score_probabilities(spark, sf_dir).groupBy("conv_id", "turn").agg(
        F.sort_array(F.collect_list(F.struct("rank", "category", "probability"))).alias("r")
    )
    odds, names = F.col("r.probability"), F.col("r.category")
    total = F.aggregate(odds, F.lit(0.0), lambda a, p: a + p)
    places = F.transform("r", lambda x, i: x["rank"] == i + 1)
    falling = F.transform(
        "r",
        lambda x, i: (i == 0)
        | (F.get(odds, i - 1) > x["probability"])
        | ((F.get(odds, i - 1) == x["probability"]) & (F.get(names, i - 1) < x["category"])),
    )
    good = (
        F.forall(places, lambda x: x)
        & F.forall(falling, lambda x: x)
        & (F.abs(total - 1.0) < 1e-9)
        & F.array_sort(names).eqNullSafe(F.lit(classes))
    )
    return lists.agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum(F.size("r")).alias("n_rows"),
        F.count_if(~good).alias("n_bad"),
    )


# --- streams ----------------------------------------------------------------------------------


def _source_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # A glob, since the table may be one file as well as a folder of files.
    schema = views.table(spark, sf_dir, name).schema
    return jobs.read_stream(spark, f"{sf_dir}/{name}.parque[t]", schema)


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored as a stream, as the log holds them afterwards."""
    log_path = new_path(spark, "stream-log")
    jobs.stream_scores(
        small_model(spark, sf_dir).model,
        _source_stream(spark, sf_dir, "documents"),
        log_path,
        new_path(spark, "stream-checkpoint"),
        "doc_id",
        available_now=True,
    ).awaitTermination()
    return store.read_log(spark, log_path).select("id", "text", "predicted_category", "confidence")


def stream_score_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed scores against batch scores of the same documents."""
    streamed = stream_scores(spark, sf_dir).select(
        "id", F.col("predicted_category").alias("streamed"), F.col("confidence").alias("c")
    )
    kept = scoring.without_blank(documents(spark, sf_dir), "text")
    batch = scoring.score(small_model(spark, sf_dir).model, kept).select(
        F.col("doc_id").alias("id"), "predicted_category", "confidence"
    )
    same = (F.col("streamed") == F.col("predicted_category")) & (
        F.abs(F.col("c") - F.col("confidence")) < 1e-9
    )
    return batch.join(streamed, "id", "full").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(same).alias("n_same")
    )


def stream_daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily figures of the log, kept by a stream."""
    events = _source_stream(spark, sf_dir, "events")
    path = new_path(spark, "stream-stats")
    jobs.stream_daily_stats(
        views.log_of(events), path, new_path(spark, "stream-checkpoint"), available_now=True
    ).awaitTermination()
    return rounded(jobs.read_daily_stats(spark, path), ["avg_confidence"])


ALL: dict[str, Query] = {
    "prediction_stats": prediction_stats,
    "category_totals": category_totals,
    "category_confidence": category_confidence,
    "daily_totals": daily_totals,
    "daily_category_trend": daily_category_trend,
    "log_summary": log_summary,
    "recent_predictions": recent_predictions,
    "recent_logged": recent_logged,
    "confidence_histogram": confidence_histogram,
    "category_share": category_share,
    "predicted_distribution": predicted_distribution,
    "log_store": log_store,
    "rollup_store": rollup_store,
    "rollup_live": rollup_live,
    "histogram_between": histogram_between,
    "summary_between": summary_between,
    "log_retry": log_retry,
    "log_compacted": log_compacted,
    "log_catalog": log_catalog,
    "label_distribution": label_distribution,
    "dataset_shape": dataset_shape,
    "dataset_preview": dataset_preview,
    "csv_articles": csv_articles,
    "csv_split": csv_split,
    "csv_texts": csv_texts,
    "prepared_text": prepared_text,
    "log_texts": log_texts,
    "stratified_split": stratified_split_rows,
    "split_counts": split_counts_by_part,
    "tokens": token_lists,
    "terms": term_lists,
    "term_counts": term_counts,
    "vocabulary": vocabulary_table,
    "tfidf": tfidf,
    "label_index": label_index,
    "accuracy": accuracy,
    "class_report": class_report,
    "weighted_metrics": weighted_metrics,
    "category_report": category_report,
    "category_detail": category_detail,
    "metric_bars": metric_bars,
    "confusion_cells": confusion_cells,
    "confusion_wide": confusion_wide,
    "run_metadata": run_metadata,
    "run_category_metrics": run_category_metrics,
    "run_confusion_matrix": run_confusion_matrix,
    "model_history": model_history,
    "metric_series": metric_series,
    "registry_summary": registry_summary,
    "registry_store": registry_store,
    "registry_append": registry_append,
    "train_report": train_report,
    "score_batch": score_batch,
    "score_probabilities": score_probabilities,
    "train_support": train_support,
    "share_contract": share_contract,
    "rank_contract": rank_contract,
    "score_contract": score_contract,
    "score_log": score_log,
    "score_csv": score_csv,
    "bundle_contract": bundle_contract,
    "log_shared": log_shared,
    "stream_scores": stream_scores,
    "stream_score_contract": stream_score_contract,
    "stream_daily_stats": stream_daily_stats,
}
