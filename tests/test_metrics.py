"""Evaluation on hand-made pairs."""

import pytest

from sextile.operators import metrics as m
from sextile.plans.training import local_counts, run_metadata

PAIRS = [
    ("Political", "Political"),
    ("Political", "Economic"),
    ("Economic", "Economic"),
    ("Legal", "Political"),
    ("Other", "Other"),
    ("Other", "Legal"),
    ("Social", "Ghost"),
]


@pytest.fixture
def counts(spark):
    return m.confusion_counts(spark.createDataFrame(PAIRS, "y_true string, y_pred string"))


def by_hand(label):
    tp = sum(t == p == label for t, p in PAIRS)
    support, predicted = (sum(pair[i] == label for pair in PAIRS) for i in (0, 1))
    precision = tp / predicted if predicted else 0.0
    recall = tp / support if support else 0.0
    both = precision + recall
    return precision, recall, 2 * precision * recall / both if both else 0.0, support


def test_accuracy(counts):
    row = m.accuracy(counts).first()
    assert (row.accuracy, row.n_rows) == (pytest.approx(3 / 7), 7)


def test_report_has_every_label(counts):
    rows = {r.label: (r.precision, r.recall, r.f1_score, r.support) for r in m.class_report(counts).collect()}
    assert set(rows) == {"Political", "Economic", "Legal", "Other", "Social", "Ghost"}
    for label, figures in rows.items():
        assert figures == pytest.approx(by_hand(label))


def test_weighted_means_count_other_labels(counts):
    row = m.weighted_metrics(m.class_report(counts)).first()
    labels = {t for t, _ in PAIRS}
    for i, name in enumerate(("precision", "recall", "f1_score")):
        assert row[name] == pytest.approx(sum(by_hand(x)[i] * by_hand(x)[3] for x in labels) / 7)
    assert row.recall == pytest.approx(m.accuracy(counts).first().accuracy)
    together = m.run_metrics(counts).first()
    assert together.n_rows == 7
    assert together.accuracy == pytest.approx(3 / 7) == together.recall
    assert together.f1_score == pytest.approx(row.f1_score)


def test_category_report_is_limited_and_in_order(counts):
    report = m.category_report(m.class_report(counts), places=3)
    rows = report.collect()
    assert [r.category for r in rows] == ["Political", "Economic", "Social", "Legal"]
    assert rows[0].precision == 0.5 and rows[0].support == 2
    bars = m.metric_bars(m.class_report(counts)).collect()
    assert len(bars) == 12 and {b.metric for b in bars} == {"precision", "recall", "f1_score"}


def test_confusion_matrix(counts):
    cells = m.confusion_cells(counts).collect()
    assert len(cells) == 36
    got = {(c.y_true, c.y_pred): c.n for c in cells if c.n}
    assert got == {
        ("Political", "Political"): 1,
        ("Political", "Economic"): 1,
        ("Economic", "Economic"): 1,
        ("Legal", "Political"): 1,
    }
    assert [c.y_true for c in cells[::6]] == list(m.CATEGORIES)
    wide = m.confusion_wide(counts).collect()
    assert [r.y_true for r in wide] == list(m.CATEGORIES)
    assert list(wide[0].asDict()) == ["y_true", *m.CATEGORIES]
    assert list(wide[0])[1:] == [1, 1, 0, 0, 0, 0]


def test_own_categories(counts):
    cells = m.confusion_cells(counts, ["Other", "Ghost"]).collect()
    assert [(c.y_true, c.y_pred, c.n) for c in cells] == [
        ("Other", "Other", 1),
        ("Other", "Ghost", 0),
        ("Ghost", "Other", 0),
        ("Ghost", "Ghost", 0),
    ]


def test_no_known_label_gives_zeros(spark):
    frame = spark.createDataFrame([("a", "b")], "y_true string, y_pred string")
    cells = m.confusion_cells(m.confusion_counts(frame)).collect()
    assert len(cells) == 36 and not any(c.n for c in cells)


def test_no_pairs(spark):
    frame = spark.createDataFrame([], "y_true string, y_pred string")
    counts = m.confusion_counts(frame)
    row = m.accuracy(counts).first()
    assert (row.accuracy, row.n_rows) == (None, 0)
    assert m.class_report(counts).count() == 0


def test_by_group(spark):
    rows = [("x", "a", "a"), ("x", "a", "b"), ("y", "a", "a")]
    frame = spark.createDataFrame(rows, "g string, y_true string, y_pred string")
    counts = m.confusion_counts(frame, by=["g"])
    got = {r.g: r.accuracy for r in m.accuracy(counts, ["g"]).collect()}
    assert got == {"x": 0.5, "y": 1.0}
    assert m.run_metrics(counts, ["g"]).count() == 2


def test_record(spark):
    frame = spark.createDataFrame(PAIRS, "y_true string, y_pred string")
    record = run_metadata(local_counts(frame), 35, 28, training_time=1.5)
    assert list(record) == [
        "model_type", "accuracy", "f1_score", "precision", "recall", "trained_date",
        "training_time", "n_samples", "n_train", "n_test", "categories", "framework",
        "category_metrics", "confusion_matrix",
    ]
    assert (record["n_samples"], record["n_train"], record["n_test"]) == (35, 28, 7)
    assert list(record["category_metrics"]) == ["Political", "Economic", "Social", "Legal"]
    assert record["confusion_matrix"]["matrix"][0] == [1, 1, 0, 0, 0, 0]
    assert record["confusion_matrix"]["labels"] == list(m.CATEGORIES)
