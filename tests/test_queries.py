"""Every registered query against its oracle on the smallest given tables."""

import pytest

import __spark_entry__ as entry
from compare import differences
from sextile.plans import queries as registered

SF = "/root/testdata/sf0.001"


def test_registration():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    without = set(registered.ALL) - set(entry.oracle_sql())
    assert without == {"train_report", "score_batch", "score_probabilities", "stream_scores"}


def test_entry(spark):
    report = entry.entry(spark)
    assert report.columns == ["category", "precision", "recall", "f1_score", "support"]
    assert report.count() > 0


@pytest.mark.parametrize("name", sorted(registered.ALL))
def test_query(spark, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert query(spark, SF).count() > 0
    else:
        assert differences(spark, SF, query, sql) is None


def test_no_python_udf_and_no_cross_join(spark):
    """Plans stay in the JVM, and no join is without a key."""
    for name in ("tokens", "terms", "tfidf", "confusion_cells", "score_batch", "model_history"):
        frame = entry.queries()[name](spark, SF)
        plan = frame._jdf.queryExecution().toString()
        assert "PythonUDF" not in plan and "ArrowEval" not in plan, name
        assert "Cartesian" not in plan and "NestedLoop" not in plan, name


def test_columns_are_pruned(spark):
    """Counting labels does not read the texts."""
    plan = entry.queries()["label_distribution"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<lang:string,n_chars:bigint>" in plan
