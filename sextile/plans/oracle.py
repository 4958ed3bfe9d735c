"""DuckDB SQL for the registered queries: an independent statement of the same results."""

from __future__ import annotations

from ..functions.constants import (
    CATEGORIES,
    ENGLISH_STOP_WORDS,
    NA_STRINGS,
    TOKEN_PATTERN,
    WHITESPACE,
)


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


VIEWS = {
    "labeled_articles": """
        SELECT doc_id AS article_id, split_part(text, chr(10), 1) AS headline,
               CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) END
                   AS description,
               CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS topic_tags,
               CASE WHEN n_chars < 200 THEN 'Legal' WHEN n_chars >= 5000 THEN 'Environmental'
                    WHEN lang = 'en' THEN 'Political' WHEN lang = 'fr' THEN 'Economic'
                    WHEN lang = 'de' THEN 'Social' ELSE 'Technological' END AS category,
               source
        FROM documents""",
    "eval_pairs": """
        SELECT article_id, source, category AS y_true,
               CASE WHEN article_id % 41 = 0 THEN 'Other' WHEN article_id % 5 = 0 THEN 'Political'
                    WHEN article_id % 11 = 0 THEN 'Economic' ELSE category END AS y_pred
        FROM labeled_articles""",
    "prediction_log": """
        SELECT event_id AS id, props AS text,
               CASE event_type WHEN 'click' THEN 'Political' WHEN 'error' THEN 'Economic'
                    WHEN 'purchase' THEN 'Social' WHEN 'signup' THEN 'Technological'
                    ELSE 'Legal' END AS predicted_category,
               CASE WHEN event_id % 50 = 0 THEN NULL ELSE value / (value + 10.0) END AS confidence,
               ts AS timestamp, CAST(ts AS DATE) AS date, 'Random Forest' AS model_version
        FROM events""",
    "stats": """
        SELECT predicted_category, date, count(*) AS count, avg(confidence) AS avg_confidence,
               max(timestamp) AS last
        FROM prediction_log GROUP BY predicted_category, date""",
    "prepared": f"""
        SELECT article_id, category, prepared_text FROM (
            SELECT article_id, category,
                   trim(lower(coalesce(headline, '') || ' ' || coalesce(description, '') || ' '
                              || coalesce(topic_tags, '')), '{WHITESPACE}') AS prepared_text
            FROM labeled_articles)
        WHERE length(prepared_text) > 0""",
    "split_articles": """
        SELECT l.article_id, l.category,
               CASE WHEN row_number() OVER (PARTITION BY l.category ORDER BY
                             md5('42|' || CAST(l.article_id AS VARCHAR)), l.article_id) <= a.k
                    THEN 'train' ELSE 'test' END AS split
        FROM prepared l JOIN (
            SELECT category, base + CASE WHEN rk <= n_train - sum(base) OVER () THEN 1 ELSE 0 END
                       AS k
            FROM (SELECT category, n_train, (n_c * n_train) // n AS base,
                         row_number() OVER (ORDER BY (n_c * n_train) % n DESC, category) AS rk
                  FROM (SELECT category, n_c, n, n - (n + 4) // 5 AS n_train
                        FROM (SELECT category, count(*) AS n_c,
                                     CAST(sum(count(*)) OVER () AS BIGINT) AS n
                              FROM prepared GROUP BY category)))
        ) a ON l.category = a.category""",
    "words": f"""
        SELECT article_id, [w FOR w IN regexp_extract_all(prepared_text, '{TOKEN_PATTERN}')
                            IF w NOT IN ({_list(ENGLISH_STOP_WORDS)})] AS words
        FROM prepared""",
    "word_terms": """
        SELECT article_id, list_concat(words, [words[i] || ' ' || words[i + 1]
                               FOR i IN range(1, len(words))]) AS terms
        FROM words""",
    "counted": """
        SELECT article_id, term, count(*) AS n
        FROM (SELECT article_id, unnest(terms) AS term FROM word_terms) GROUP BY article_id, term""",
    "vocabulary": """
        SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df,
               (SELECT count(*) FROM split_articles WHERE split = 'train') AS n_docs
        FROM counted JOIN split_articles USING (article_id) WHERE split = 'train' GROUP BY term
        HAVING count(*) >= 2 AND count(*) <= CAST(0.95 AS DOUBLE)
                   * (SELECT count(*) FROM split_articles WHERE split = 'train')
        ORDER BY tf DESC, term LIMIT 5000""",
    "weights": """
        SELECT article_id, term, n * (ln((1.0 + n_docs) / (1.0 + df)) + 1.0) AS w
        FROM counted JOIN vocabulary USING (term)""",
    "pairs": "SELECT y_true, y_pred FROM eval_pairs",
    "test_pairs": """
        SELECT y_true, y_pred FROM eval_pairs JOIN split_articles USING (article_id)
        WHERE split = 'test'""",
    "labels_of_pairs": "SELECT y_true AS label FROM {pairs} UNION SELECT y_pred FROM {pairs}",
    "report": """
        SELECT label, coalesce(tp / nullif(predicted, 0), 0) AS precision,
               coalesce(tp / nullif(support, 0), 0) AS recall,
               coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1_score,
               CAST(support AS BIGINT) AS support
        FROM (SELECT label,
                     CAST(count(*) FILTER (y_true = label AND y_pred = label) AS DOUBLE) AS tp,
                     CAST(count(*) FILTER (y_true = label) AS DOUBLE) AS support,
                     CAST(count(*) FILTER (y_pred = label) AS DOUBLE) AS predicted
              FROM labels_of_pairs JOIN {pairs} ON y_true = label OR y_pred = label
              GROUP BY label)""",
    "categories": "SELECT unnest([{categories}]) AS category, unnest(range(6)) AS pos",
    "source_labels": """
        SELECT source, y_true AS label FROM eval_pairs
        UNION SELECT source, y_pred FROM eval_pairs""",
    "source_report": """
        SELECT s.source, label, CAST(count(*) FILTER (y_true = label AND y_pred = label) AS DOUBLE)
                   AS tp,
               CAST(count(*) FILTER (y_true = label) AS DOUBLE) AS support,
               CAST(count(*) FILTER (y_pred = label) AS DOUBLE) AS predicted
        FROM source_labels s JOIN eval_pairs p
             ON s.source = p.source AND (y_true = label OR y_pred = label)
        GROUP BY s.source, label""",
    "model_runs": """
        SELECT CAST(substr(source, 4) AS BIGINT) AS id, 'model_' || source AS model_name,
               accuracy, n_samples, f1_score, precision_score, recall_score,
               CAST(DATE '2024-01-01' + CAST((CAST(substr(source, 4) AS INT) * 7) % 20 AS INT)
                    AS DATE) AS trained_date
        FROM (SELECT source, avg(CAST(y_true = y_pred AS INT)) AS accuracy, count(*) AS n_samples
              FROM eval_pairs GROUP BY source)
        JOIN (SELECT source,
                     sum(coalesce(2 * tp / nullif(support + predicted, 0), 0) * support)
                         / sum(support) AS f1_score,
                     sum(coalesce(tp / nullif(predicted, 0), 0) * support) / sum(support)
                         AS precision_score,
                     sum(coalesce(tp / nullif(support, 0), 0) * support) / sum(support)
                         AS recall_score
              FROM source_report GROUP BY source) USING (source)""",
}

# The views that each view reads, in order of definition.
NEEDS = {
    "eval_pairs": ["labeled_articles"],
    "stats": ["prediction_log"],
    "prepared": ["labeled_articles"],
    "split_articles": ["prepared"],
    "words": ["prepared"],
    "word_terms": ["words"],
    "counted": ["word_terms"],
    "vocabulary": ["counted", "split_articles"],
    "weights": ["vocabulary"],
    "pairs": ["eval_pairs"],
    "test_pairs": ["eval_pairs", "split_articles"],
    "source_labels": ["eval_pairs"],
    "source_report": ["source_labels"],
    "model_runs": ["source_report"],
}


def _with(names: str, body: str, pairs: str = "pairs") -> str:
    """`body` after the definitions of the named views and of all that they read."""
    needs = {**NEEDS, "labels_of_pairs": [pairs], "report": ["labels_of_pairs"]}
    order: list[str] = []

    def add(name: str) -> None:
        for needed in needs.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    fill = {"{pairs}": pairs, "{categories}": _list(CATEGORIES)}
    parts = []
    for name in order:
        sql = VIEWS[name]
        for mark, value in fill.items():
            sql = sql.replace(mark, value)
        parts.append(f"{name} AS ({sql})")
    return f"WITH {', '.join(parts)} {body}"


_ROW_MEAN = "(SELECT avg(confidence) FROM prediction_log)"
_REPORT = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score"
_CELLS = """
    SELECT t.category AS y_true, p.category AS y_pred, count(y_true) AS n
    FROM categories t JOIN categories p ON true
    LEFT JOIN {pairs} ON y_true = t.category AND y_pred = p.category
    GROUP BY t.category, p.category"""
_WEIGHTED = ", ".join(
    f"round(sum({m} * support) / sum(support), 6) AS {m}"
    for m in ("precision", "recall", "f1_score")
)


def _na_null(column: str) -> str:
    return f"CASE WHEN {column} IN ({_list(NA_STRINGS)}) THEN NULL ELSE {column} END"


ALL: dict[str, str] = {
    "prediction_stats": _with(
        "stats",
        """SELECT predicted_category, count, round(avg_confidence, 6) AS avg_confidence, date,
                  row_number() OVER (ORDER BY last DESC, predicted_category) AS rank
           FROM stats""",
    ),
    "rollup_store": _with(
        "stats",
        """SELECT predicted_category, count, round(avg_confidence, 6) AS avg_confidence, date,
                  row_number() OVER (ORDER BY last DESC, predicted_category) AS rank
           FROM stats""",
    ),
    "category_totals": _with(
        "stats",
        """SELECT predicted_category, CAST(sum(count) AS BIGINT) AS count FROM stats
           GROUP BY predicted_category""",
    ),
    "category_confidence": _with(
        "stats",
        """SELECT predicted_category, round(avg(avg_confidence), 6) AS avg_confidence,
                  round((SELECT avg(confidence) FROM prediction_log p
                         WHERE p.predicted_category = s.predicted_category), 6)
                      AS row_avg_confidence,
                  row_number() OVER (ORDER BY avg(avg_confidence) DESC, predicted_category) AS rank
           FROM stats s GROUP BY predicted_category""",
    ),
    "daily_totals": _with(
        "stats", "SELECT date, CAST(sum(count) AS BIGINT) AS count FROM stats GROUP BY date"
    ),
    "daily_category_trend": _with("stats", "SELECT date, predicted_category, count FROM stats"),
    "log_summary": _with(
        "stats",
        f"""SELECT CAST(sum(count) AS BIGINT) AS total_predictions,
                  round(avg(avg_confidence), 6) AS avg_confidence,
                  round({_ROW_MEAN}, 6) AS row_avg_confidence,
                  count(DISTINCT predicted_category) AS active_categories
           FROM stats""",
    ),
    "recent_predictions": _with(
        "prediction_log",
        """SELECT text, predicted_category, round(confidence, 6) AS confidence, timestamp
           FROM prediction_log ORDER BY timestamp DESC, id DESC LIMIT 20""",
    ),
    "recent_logged": _with(
        "prediction_log",
        """SELECT text, predicted_category, round(confidence, 6) AS confidence, timestamp
           FROM prediction_log ORDER BY timestamp DESC, id DESC LIMIT 20""",
    ),
    "confidence_histogram": _with(
        "prediction_log",
        """SELECT CAST(b.bin AS INT) AS bin, round(CAST(b.bin AS DOUBLE) / 20, 6) AS bin_start,
                  round(CAST(b.bin + 1 AS DOUBLE) / 20, 6) AS bin_end, count(p.bin) AS count
           FROM (SELECT unnest(range(20)) AS bin) b
           LEFT JOIN (SELECT least(floor(confidence * 20), 19) AS bin FROM prediction_log
                      WHERE confidence IS NOT NULL) p ON b.bin = p.bin
           GROUP BY b.bin""",
    ),
    "category_share": _with(
        "prediction_log",
        """SELECT predicted_category, count(*) AS count,
                  round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM prediction_log), 6) AS share
           FROM prediction_log GROUP BY predicted_category""",
    ),
    "predicted_distribution": _with(
        "prediction_log",
        "SELECT predicted_category, count(*) AS count FROM prediction_log GROUP BY 1",
    ),
    "log_store": _with(
        "prediction_log",
        """SELECT id, substr(text, 1, 500) AS text, predicted_category,
                  round(confidence, 6) AS confidence, model_version, date
           FROM prediction_log""",
    ),
    "label_distribution": _with(
        "labeled_articles", "SELECT category, count(*) AS count FROM labeled_articles GROUP BY 1"
    ),
    "dataset_shape": "SELECT count(*) AS n_rows, CAST(5 AS INT) AS n_columns FROM documents",
    "dataset_preview": _with(
        "labeled_articles",
        """SELECT article_id, headline AS "Headline", description AS "Description",
                  topic_tags AS "Topic_Tags", category AS "PESTLE_Category"
           FROM labeled_articles ORDER BY article_id LIMIT 10""",
    ),
    "csv_articles": _with(
        "labeled_articles",
        f"""SELECT CAST(article_id AS VARCHAR) AS article_id, {_na_null("headline")} AS "Headline",
                  {_na_null("description")} AS "Description",
                  {_na_null("topic_tags")} AS "Topic_Tags", category AS "PESTLE_Category"
           FROM labeled_articles""",
    ),
    "csv_texts": f"""SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn,
                            role, {_na_null("text")} AS text FROM conversations""",
    "prepared_text": _with("prepared", "SELECT article_id, category, prepared_text FROM prepared"),
    "log_texts": f"""SELECT doc_id AS id, substr(text, 1, 500) AS text,
                            source AS predicted_category, CAST(0.5 AS DOUBLE) AS confidence,
                            'Unknown' AS model_version
                     FROM documents WHERE length(trim(text, '{WHITESPACE}')) > 0""",
    "stratified_split": _with("split_articles", "SELECT * FROM split_articles"),
    "split_counts": _with(
        "split_articles", "SELECT split, count(*) AS n FROM split_articles GROUP BY split"
    ),
    "tokens": _with(
        "words",
        """SELECT article_id, CAST(len(words) AS INT) AS n_tokens,
                  array_to_string(words, ' ') AS tokens FROM words""",
    ),
    "terms": _with(
        "word_terms",
        """SELECT article_id, CAST(len(terms) AS INT) AS n_terms,
                  array_to_string(terms, '|') AS terms FROM word_terms""",
    ),
    "term_counts": _with(
        "counted",
        """SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM counted GROUP BY term
           HAVING count(*) >= 2
              AND count(*) <= CAST(0.95 AS DOUBLE) * (SELECT count(*) FROM prepared)""",
    ),
    "vocabulary": _with(
        "vocabulary",
        """SELECT term, tf, df, round(ln((1.0 + n_docs) / (1.0 + df)) + 1.0, 6) AS idf
           FROM vocabulary""",
    ),
    "tfidf": _with(
        "weights",
        """SELECT article_id, term,
                  round(w / sqrt(sum(w * w) OVER (PARTITION BY article_id)), 6) AS weight
           FROM weights""",
    ),
    "label_index": _with(
        "prepared",
        """SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INT) AS label, n
           FROM (SELECT category, count(*) AS n FROM prepared GROUP BY category)""",
    ),
    "accuracy": _with(
        "pairs",
        """SELECT round(avg(CAST(y_true = y_pred AS INT)), 6) AS accuracy, count(*) AS n_rows
           FROM pairs""",
    ),
    "class_report": _with("report", f"SELECT label, {_REPORT}, support FROM report"),
    "weighted_metrics": _with("report", f"SELECT {_WEIGHTED} FROM report"),
    "category_report": _with(
        "report categories",
        f"""SELECT category, {_REPORT}, support FROM report JOIN categories ON label = category""",
    ),
    "category_detail": _with(
        "report categories",
        """SELECT category, round(precision, 3) AS precision, round(recall, 3) AS recall,
                  round(f1_score, 3) AS f1_score, support
           FROM report JOIN categories ON label = category""",
    ),
    "metric_bars": _with(
        "report categories",
        """SELECT category, metric, round(value, 6) AS value FROM (
               SELECT category, 'precision' AS metric, precision AS value
               FROM report JOIN categories ON label = category
               UNION ALL SELECT category, 'recall', recall
               FROM report JOIN categories ON label = category
               UNION ALL SELECT category, 'f1_score', f1_score
               FROM report JOIN categories ON label = category)""",
    ),
    "confusion_cells": _with("pairs categories", _CELLS.replace("{pairs}", "pairs")),
    "confusion_wide": _with(
        "pairs categories",
        "SELECT category AS y_true, "
        + ", ".join(f"count(*) FILTER (y_pred = '{c}') AS \"{c}\"" for c in CATEGORIES)
        + " FROM categories LEFT JOIN pairs ON y_true = category GROUP BY category",
    ),
    "run_metadata": _with(
        "report split_articles",
        f"""SELECT 'Random Forest' AS model_type,
                  (SELECT round(avg(CAST(y_true = y_pred AS INT)), 6) FROM test_pairs) AS accuracy,
                  {_WEIGHTED}, (SELECT count(*) FROM split_articles) AS n_samples,
                  (SELECT count(*) FROM split_articles WHERE split = 'train') AS n_train,
                  (SELECT count(*) FROM split_articles WHERE split = 'test') AS n_test,
                  'Spark ML' AS framework, '{", ".join(CATEGORIES)}' AS categories
           FROM report""",
        pairs="test_pairs",
    ),
    "run_category_metrics": _with(
        "report categories",
        f"""SELECT category, {_REPORT}, support FROM report JOIN categories ON label = category""",
        pairs="test_pairs",
    ),
    "run_confusion_matrix": _with(
        "test_pairs categories", _CELLS.replace("{pairs}", "test_pairs")
    ),
    "model_history": _with(
        "model_runs",
        """SELECT model_name, round(accuracy, 6) AS accuracy, round(f1_score, 6) AS f1_score,
                  trained_date, n_samples, CAST(1 AS DOUBLE) AS training_time,
                  id = (SELECT max(id) FROM model_runs) AS is_active,
                  row_number() OVER (ORDER BY trained_date DESC, id DESC) AS rank
           FROM model_runs""",
    ),
    "metric_series": _with(
        "model_runs",
        """SELECT id, trained_date, 'accuracy' AS metric, round(accuracy, 6) AS value
           FROM model_runs
           UNION ALL SELECT id, trained_date, 'f1_score', round(f1_score, 6) FROM model_runs""",
    ),
    "registry_summary": _with(
        "model_runs",
        "SELECT count(*) AS n_models, round(max(accuracy), 6) AS best_accuracy FROM model_runs",
    ),
    "registry_store": _with(
        "model_runs",
        """SELECT id, model_name, round(accuracy, 6) AS accuracy, round(f1_score, 6) AS f1_score,
                  round(precision_score, 6) AS precision_score,
                  round(recall_score, 6) AS recall_score, trained_date, n_samples,
                  id = (SELECT max(id) FROM model_runs) AS is_active
           FROM model_runs""",
    ),
    "registry_append": _with(
        "report split_articles",
        f"""SELECT 'Random Forest' AS model_name,
                  (SELECT round(avg(CAST(y_true = y_pred AS INT)), 6) FROM test_pairs) AS accuracy,
                  f1_score, precision AS precision_score, recall AS recall_score,
                  (SELECT count(*) FROM split_articles) AS n_samples,
                  (SELECT count(*) FROM split_articles WHERE split = 'train') AS n_train,
                  (SELECT count(*) FROM split_articles WHERE split = 'test') AS n_test,
                  'Spark ML' AS framework, true AS is_active
           FROM (SELECT {_WEIGHTED} FROM report)""",
        pairs="test_pairs",
    ),
    "score_csv": f"""
        SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn,
               role, {_na_null("text")} AS text, {_na_null("text")} IS NOT NULL AS known,
               {_na_null("text")} IS NOT NULL AS sure
        FROM conversations""",
    "bundle_contract": """
        SELECT count(*) AS n_rows, count(*) AS n_same, true AS same_record FROM documents""",
    "log_shared": f"""SELECT doc_id AS id, substr(text, 1, 500) AS text, 'Unknown' AS model_version
                      FROM documents WHERE length(trim(text, '{WHITESPACE}')) > 0""",
    "score_contract": """
        SELECT count(*) AS n_rows, CAST(sum(doc_id) AS BIGINT) AS key_sum,
               CAST(0 AS BIGINT) AS n_unknown_labels, CAST(0 AS BIGINT) AS n_bad_confidence,
               CAST(0 AS BIGINT) AS n_bad_sums, CAST(0 AS BIGINT) AS n_not_largest,
               CAST(0 AS BIGINT) AS n_wrong_classes
        FROM documents""",
    "score_log": f"""SELECT doc_id AS id, substr(text, 1, 500) AS text, 'Unknown' AS model_version
                     FROM documents WHERE length(trim(text, '{WHITESPACE}')) > 0""",
    "stream_score_contract": f"""
        SELECT count(*) AS n_rows, count(*) AS n_same FROM documents
        WHERE length(trim(text, '{WHITESPACE}')) > 0""",
    "stream_daily_stats": _with(
        "stats",
        """SELECT predicted_category, count, round(avg_confidence, 6) AS avg_confidence, date
           FROM stats""",
    ),
}

_DAYS = "date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'"

ALL |= {
    # The same rows by another way.
    "csv_split": ALL["csv_articles"],
    "log_retry": ALL["log_texts"],
    "log_compacted": ALL["score_log"],
    "log_catalog": ALL["log_store"],
    "rollup_live": ALL["prediction_stats"],
    "train_support": _with(
        "split_articles",
        "SELECT category, count(*) AS support FROM split_articles WHERE split = 'test' GROUP BY category",
    ),
    "share_contract": _with(
        "split_articles",
        """SELECT count(*) AS n_train, count(*) AS n_fitted, CAST(0 AS BIGINT) AS n_over,
                  CAST(0 AS BIGINT) AS n_trees_off,
                  (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_scored,
                  CAST(0 AS BIGINT) AS n_bad
           FROM split_articles WHERE split = 'train'""",
    ),
    "rank_contract": _with(
        "prepared",
        """SELECT count(*) AS n_texts,
                  count(*) * (SELECT count(DISTINCT category) FROM prepared) AS n_rows,
                  CAST(0 AS BIGINT) AS n_bad
           FROM conversations WHERE text IS NOT NULL""",
    ),
    "histogram_between": _with(
        "prediction_log",
        f"""SELECT CAST(b.bin AS INTEGER) AS bin, round(b.bin / 20, 6) AS bin_start,
                   round((b.bin + 1) / 20, 6) AS bin_end, count(p.id) AS count
            FROM range(20) b(bin) LEFT JOIN prediction_log p
              ON p.confidence IS NOT NULL AND {_DAYS}
                 AND greatest(0, least(19, CAST(floor(p.confidence * 20) AS INTEGER))) = b.bin
            GROUP BY b.bin""",
    ),
    "summary_between": _with(
        "prediction_log",
        f"""SELECT count(*) AS total_predictions, round(avg(confidence), 6) AS row_avg_confidence,
                   count(DISTINCT predicted_category) AS active_categories
            FROM prediction_log WHERE {_DAYS}""",
    ),
}
