"""Registered queries against their oracles, and the pipeline against its own promises."""

import pytest
from compare import differences

import corpus_pipeline
from sextile.llm import langid, oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.ALL))
def test_oracle(spark, name):
    assert differences(spark, SF, queries.ALL[name], oracle.ALL[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.ALL) - set(oracle.ALL)))
def test_rows(spark, name):
    frame = queries.ALL[name](spark, SF)
    key = "page_id" if "page_id" in frame.columns else "doc_id"
    table = spark.read.parquet(f"{SF}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    assert frame.join(table, key, "left_anti").count() == 0
    if name not in ("op8_leaks", "op1_packing"):
        assert frame.count() == table.count()


def test_licences_stay_native(spark):
    plan = queries.op3_licences(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "leaks", "packing"]
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, SF)
        assert after.columns == docs.columns
        assert after.exceptAll(left).count() == 0
        left = after
    pieces = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {
        r.doc_id for r in left.select("doc_id").collect()
    }
    assert left.count() < docs.count()
    filled = pieces.groupBy("sequence_id").agg({"length": "sum"}).toPandas()
    assert filled["sum(length)"].max() <= 2048


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, `a.b` int"
    rows = [(1, None, None, None, None, "x", 1), (None, "some text", "en", "s", 9, None, None)]
    rows += [(2, "A text of words", "en", "s", 9, "y", 2)] * 2
    rows += [(3, "a TEXT of words", None, None, None, None, None), (4, "", "en", "s", 0, "z", 3)]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.known_language(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 2, 3]
    assert [r.doc_id for r in corpus_pipeline.without_copies(spark, kept, SF).collect()] == [3]
    near = corpus_pipeline.without_near_copies(spark, kept, SF).collect()
    assert [r.doc_id for r in near] == [2]
    again = kept.where("doc_id = 2")
    for stage in (corpus_pipeline.without_copies, corpus_pipeline.without_near_copies):
        assert [tuple(r) for r in stage(spark, again, SF).collect()] == [rows[2]]
    assert corpus_pipeline.without_leaks(spark, kept, SF).count() == 3
    assert corpus_pipeline.packed(spark, kept.limit(0), SF).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns


def test_languages_that_were_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = langid.learn(docs)
    kept = langid.known_only(docs, profiles)
    lost = docs.where("lang IS NOT NULL").join(kept, "doc_id", "left_anti")
    assert lost.where("text RLIKE '[A-Za-z]'").count() == 0
    odd = ["Съешь же ещё этих мягких французских булок, да выпей чаю", "いろはにほへとちりぬるをわかよたれそつねならむういのおくやま", "日本 語テキスト " * 50]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*odd, "Ый", None])], "doc_id long, text string")
    assert [r.doc_id for r in langid.known_only(frame, profiles).collect()] == [3]
    nothing = langid.learn(docs.limit(0))
    assert langid.known_only(frame, nothing).count() == 5
