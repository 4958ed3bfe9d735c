"""Training, storing and scoring."""

import os
from dataclasses import replace

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sextile import ForestParams, predict, score, score_and_log, train
from sextile.operators import analytics, features
from sextile.plans import queries, scoring, training
from sextile.sources import bundle, store
from sextile.sources.shared import shared_dir

SF = "/root/testdata/sf0.001"
TINY = ForestParams(num_trees=5, max_depth=4, max_features=200)

WORDS = {"Political": "senate vote", "Economic": "bank inflation", "Other": "zebra giraffe"}


def articles(spark, n=60):
    rows = []
    for i in range(n):
        label = list(WORDS)[i % 3]
        rows.append((i, None if i % 4 == 0 else f"Report {i}", WORDS[label], "tag", label, "kept"))
    rows += [(1000, None, "", "  ", "Political", "empty"), (1001, " ", None, "\n", "Ghost", "empty")]
    return spark.createDataFrame(
        rows,
        "id long, Headline string, Description string, Topic_Tags string, PESTLE_Category string,"
        " text string",
    )


@pytest.fixture(scope="module")
def trained(spark):
    return train(articles(spark), "id", params=TINY)


def test_record(trained):
    record = trained.metadata
    # Empty articles do not count, and neither does their label.
    assert (record["n_samples"], record["n_train"], record["n_test"]) == (60, 48, 12)
    assert record["accuracy"] == record["recall"] == 1.0
    # A label outside the categories is trained on, and left out of the report and the matrix.
    assert list(record["category_metrics"]) == ["Political", "Economic"]
    assert sum(map(sum, record["confusion_matrix"]["matrix"])) == 8
    assert record["training_time"] > 0
    assert scoring.classes_of(trained.model) == ["Economic", "Other", "Political"]


def test_score(spark, trained):
    rows = [
        (1, "a", "The SENATE will vote"),
        (2, "b", "inflation bank"),
        (3, "c", ""),
        (4, "d", "zzzz qqqq"),
        (5, "e", None),
    ]
    texts = spark.createDataFrame(rows, "k long, extra string, text string")
    plain = score(trained.model, texts)
    assert plain.columns == ["k", "extra", "text", "predicted_category", "confidence"]
    scored = score(trained.model, texts, probabilities=True)
    assert scored.columns == [*plain.columns, "probabilities"]
    got = {r.k: r for r in scored.collect()}
    assert [tuple(got[i])[:3] for i in got] == rows
    assert got[1].predicted_category == "Political" and got[2].predicted_category == "Economic"
    assert got[3].predicted_category == got[4].predicted_category
    assert got[3].probabilities == got[4].probabilities
    assert (got[5].predicted_category, got[5].confidence, got[5].probabilities) == (None,) * 3
    for i in (1, 2, 3, 4):
        odds = got[i].probabilities
        assert sorted(odds) == ["Economic", "Other", "Political"]
        assert sum(odds.values()) == pytest.approx(1)
        assert got[i].confidence == max(odds.values()) == odds[got[i].predicted_category]
    with pytest.raises(Exception, match="null in column text"):
        score(trained.model, texts, on_null="fail").collect()
    with pytest.raises(ValueError):
        score(trained.model, texts, on_null="other")


def test_score_replaces_old_results_and_reads_other_columns(spark, trained):
    frame = spark.createDataFrame([("x", 1, "Senate vote tag")], "confidence string, k int, body string")
    scored = score(trained.model, frame, text_col="body")
    assert scored.columns == ["confidence", "k", "body", "predicted_category"]
    assert scored.first().predicted_category == "Political"


def test_predict_one_text(spark, trained):
    got = predict(spark, trained.model, "Senate VOTE tag")
    assert got["category"] == "Political"
    assert got["confidence"] == max(got["probabilities"].values())
    assert sum(got["probabilities"].values()) == pytest.approx(1)
    with pytest.raises(Exception, match="null"):
        predict(spark, trained.model, None)


def test_training_leaves_no_tables_behind(spark):
    before = set(os.listdir(shared_dir(spark)))
    train(articles(spark), "id", params=TINY)
    left = set(os.listdir(shared_dir(spark))) - before
    assert not [name for name in left if name.startswith("word")]


def test_ranked(spark, trained):
    texts = spark.createDataFrame([(1, "senate vote tag"), (2, None)], "k long, text string")
    scored = score(trained.model, texts, probabilities=True)
    rows = scoring.ranked_probabilities(scored, ["k"]).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3]
    assert [r.probability for r in rows] == sorted((r.probability for r in rows), reverse=True)
    assert rows[0].category == "Political"


def test_same_data_gives_the_same_model(spark, trained):
    again = train(articles(spark).repartition(3), "id", params=TINY)
    texts = articles(spark).withColumn("text", F.col("Description"))
    left = score(trained.model, texts, probabilities=True).orderBy("id").collect()
    right = score(again.model, texts, probabilities=True).orderBy("id").collect()
    assert left == right
    same = {k: v for k, v in trained.metadata.items() if k not in ("trained_date", "training_time")}
    assert same == {k: again.metadata[k] for k in same}


def test_input_is_left_alone_and_checked(spark):
    frame = articles(spark)
    with pytest.raises(ValueError, match="Topic_Tags"):
        train(frame.drop("Topic_Tags"), "id", params=TINY)
    assert "text" in frame.columns
    labels = F.when(F.col("id") != 7, F.col("PESTLE_Category"))
    with pytest.raises(ValueError, match="1 rows have no label"):
        train(frame.withColumn("PESTLE_Category", labels), "id", params=TINY)
    alone = F.when(F.col("id") == 7, "Lonely").otherwise(F.col("PESTLE_Category"))
    with pytest.raises(ValueError, match="Lonely"):
        train(frame.withColumn("PESTLE_Category", alone), "id", params=TINY)


def test_partitions_of_the_fit(spark):
    assert training.fit_partitions(8000, 5000) == training.FIT_PARTITIONS
    assert training.fit_partitions(10**9, 5000) == -(-2 * 10**13 // 2**30)


def test_progress(spark):
    said = []
    train(articles(spark), "id", params=TINY, progress=said.append)
    assert said[0] == "preparing data" and said[-1] == "done"
    assert "split: 48 train, 12 test" in said


@pytest.mark.parametrize("n_rows", [51_200, 512_000, 3_072_000, 20_000_000, 10**8])
def test_a_task_of_the_fit_has_few_binned_rows(n_rows):
    """128 MB where up to a few thousand tasks can do, and never more than 1 GB."""
    each = n_rows * 5000 * 4 / training.fit_partitions(n_rows, 5000)
    assert each <= (2**27 if n_rows <= 20_000_000 else 2**30)


def test_a_pass_of_the_fit_reads_its_rows_once(spark):
    """Rows do not remember their nodes, which would read them twice and more, and the forest is the same."""
    rows = [(i, float(i % 3), Vectors.dense([i % 3 + i % 5, i % 7, i % 2])) for i in range(300)]
    frame = spark.createDataFrame(rows, ["id", features.LABEL_INDEX, features.FEATURES])
    forest = training.fit_forest(frame, "id", TINY, 4)
    assert not forest.getCacheNodeIds()
    placed = frame.repartition(4, "id").sortWithinPartitions("id")
    remembering = RandomForestClassifier(
        labelCol=features.LABEL_INDEX, featuresCol=features.FEATURES, numTrees=TINY.num_trees,
        maxDepth=TINY.max_depth, minInstancesPerNode=TINY.min_leaf, featureSubsetStrategy="sqrt",
        seed=TINY.seed, cacheNodeIds=True,
    ).fit(placed)
    shown = [m.toDebugString.split("\n", 1)[1] for m in (forest, remembering)]
    assert shown[0] == shown[1]


def test_save_and_load(spark, trained, folder):
    path = bundle.save_model(spark, trained.model, trained.metadata, folder, "first")
    assert path == f"{folder}/first"
    bundle.save_model(spark, trained.model, trained.metadata, folder, "first")
    model, record = bundle.load_model(spark, folder, "first")
    assert record == trained.metadata
    texts = articles(spark).withColumn("text", F.col("Description"))
    assert (
        score(model, texts, probabilities=True).orderBy("id").collect()
        == score(trained.model, texts, probabilities=True).orderBy("id").collect()
    )
    with pytest.raises(FileNotFoundError):
        bundle.load_model(spark, folder, "second")


def test_score_and_log(spark, trained, folder):
    path, _ = store.create_tables(spark, folder)
    rows = [(1, "SENATE vote tag " + "x" * 600), (2, " \n"), (3, None), (4, "bank inflation tag")]
    texts = spark.createDataFrame(rows, "k long, text string")
    assert score(trained.model, texts).count() == 4
    assert store.read_log(spark, path).count() == 0
    version = trained.metadata.get("model_type")
    score_and_log(trained.model, texts, path, "k", version=version)
    logged = store.read_log(spark, path).orderBy("id").collect()
    assert [r.id for r in logged] == [1, 4]
    assert logged[0].text == rows[0][1][:500]
    assert [r.predicted_category for r in logged] == ["Political", "Economic"]
    assert {r.model_version for r in logged} == {"Random Forest"}
    rollup = analytics.daily_rollup(store.read_log(spark, path))
    assert analytics.log_summary(rollup).first().total_predictions == 2


def test_quality_on_given_articles(spark):
    """The classes follow language and length, so a small forest beats the largest class."""
    record = queries.small_model(spark, SF).metadata
    largest = analytics.value_counts(queries.articles(spark, SF), "PESTLE_Category").first()
    assert record["accuracy"] > largest["count"] / record["n_samples"]


def test_the_forest_runs_once_per_row(spark, trained, folder):
    """No filter on a result is pushed below the model, where it would run it again."""
    texts = spark.createDataFrame([(1, "bank")], "k long, text string")
    rows = scoring.scored_log_rows(trained.model, texts, "k")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_sx_raw#") and plan.count("UDF(UDF(UDF(UDF(") == 1


def test_bound_on_the_rows_of_the_fit(spark, trained):
    bounded = replace(TINY, max_fit_rows=20)
    got = training.train(articles(spark), "id", params=bounded).metadata
    assert got["n_fit"] == 20 and got["n_nodes"] > 0
    for key in ("n_samples", "n_train", "n_test"):
        assert got[key] == trained.metadata[key]
    assert trained.metadata["n_fit"] == trained.metadata["n_train"]
    with pytest.raises(ValueError, match="max_fit_rows"):
        training.train(articles(spark), "id", params=replace(TINY, max_fit_rows=1))


def test_names_with_dots_and_results_in_place(spark, trained):
    frame = spark.createDataFrame([("x", 1, "old", "a text")], ["confidence", "a.b", "c d`e", "text"])
    scored = scoring.score(trained.model, frame)
    assert scored.columns == ["confidence", "a.b", "c d`e", "text", "predicted_category"]
    row = scored.first()
    assert isinstance(row[0], float) and row[1:4] == (1, "old", "a text")


def test_shares_make_one_forest(spark, folder):
    """All rows are fitted in shares within the bound, and the forest is as good as a single one."""
    labelled = queries.articles(spark, SF.replace("0.001", "0.01"))
    params = replace(queries.SMALL, num_trees=20)
    whole = train(labelled, "article_id", params=params)
    parts = train(labelled, "article_id", params=replace(params, share_rows=300))
    record = parts.metadata
    assert sum(record["fit_shares"]) == record["n_train"] == record["n_fit"]
    assert len(record["fit_shares"]) >= 3 and max(record["fit_shares"]) <= 300
    assert record["n_trees"] == 20 and record["n_nodes"] < whole.metadata["n_nodes"]
    assert record["accuracy"] >= whole.metadata["accuracy"] - 0.05
    text = "senate vote on the bank"
    bundle.save_model(spark, parts.model, record, folder, "shares")
    again = bundle.load_model(spark, folder, "shares")[0]
    texts = spark.createDataFrame([(text,)], "text string")
    rows = [score(m, texts, probabilities=True).first() for m in (parts.model, again)]
    assert rows[0] == rows[1]
    assert predict(spark, again, text)["confidence"] == pytest.approx(rows[0].confidence)
    with pytest.raises(ValueError, match="shares"):
        train(labelled, "article_id", params=replace(params, share_rows=10))
