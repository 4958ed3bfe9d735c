"""CSV reading, checks and writing."""

import csv as plain_csv
import glob
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from sextile.functions.constants import ARTICLE_COLUMNS
from sextile.sources import csv
from sextile.plans import queries
from sextile.sources.shared import Scratch, new_path, shared_dir, spread, stored_bytes


def write(path, text):
    with open(path, "w", encoding="utf-8", newline="") as file:
        file.write(text)
    return str(path)


def test_quotes_breaks_and_missing_words(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        "Topic_Tags,Headline,Description,PESTLE_Category,extra\n"
        '"x, y","He said ""no""","line one\nline two",Legal,1\n'
        "NA,null,NaN,Social,\n"
        "na, pad ,N/A,Social,2\n",
    )
    frame = csv.read_labelled_articles(spark, path)
    assert frame.columns == ["Topic_Tags", "Headline", "Description", "PESTLE_Category", "extra"]
    rows = sorted(map(tuple, frame.collect()), key=str)
    assert rows == sorted(
        [
            ("x, y", 'He said "no"', "line one\nline two", "Legal", "1"),
            (None, None, None, "Social", None),
            ("na", " pad ", None, "Social", "2"),
        ],
        key=str,
    )


def test_missing_columns_are_named(spark, tmp_path):
    path = write(tmp_path / "a.csv", "headline,Description,PESTLE_Category\na,b,c\n")
    with pytest.raises(ValueError) as error:
        csv.read_labelled_articles(spark, path)
    said = str(error.value)
    assert "missing required columns: Headline, Topic_Tags;" in said
    assert "available columns: headline, Description, PESTLE_Category" in said
    with pytest.raises(ValueError, match="text"):
        csv.read_texts(spark, path)
    assert csv.require_columns(spark.range(1), ["id"]).count() == 1


def test_write_is_read_by_another_reader(spark, folder):
    rows = [(1, ' a,"b"\nc ', "Legal", 0.5), (2, "", "Social", None), (3, None, "Social", 1.0)]
    frame = spark.createDataFrame(rows, "id long, text string, predicted_category string, confidence double")
    csv.write_csv(frame.coalesce(1), f"{folder}/out")
    (part,) = glob.glob(f"{folder}/out/*.csv")
    with open(part, newline="", encoding="utf-8") as file:
        got = list(plain_csv.reader(file))
    assert got[0] == ["id", "text", "predicted_category", "confidence"]
    assert sorted(got[1:]) == [
        ["1", ' a,"b"\nc ', "Legal", "0.5"],
        ["2", "", "Social", ""],
        ["3", "", "Social", "1.0"],
    ]
    back = csv.read_texts(spark, f"{folder}/out").orderBy("id").collect()
    assert [r.text for r in back] == [' a,"b"\nc ', None, None]


def test_land_gives_stable_keys(spark, folder):
    frame = spark.range(50).selectExpr("cast(id as string) text").repartition(4)
    landed = csv.land(frame, f"{folder}/landed", "row_id")
    assert landed.select("row_id").distinct().count() == 50
    assert sorted(landed.collect()) == sorted(landed.collect())
    with pytest.raises(ValueError, match="exists"):
        csv.land(frame, f"{folder}/again", "text")


def test_shape_and_preview(spark):
    frame = spark.range(30).selectExpr("id", "id * 2 AS b").repartition(5)
    assert tuple(csv.shape(frame).first()) == (30, 2)
    assert [r.id for r in csv.preview(frame, "id").collect()] == list(range(10))
    assert csv.preview(frame, "id", 5).count() == 5


def test_spread(spark):
    one = spark.range(100, numPartitions=1)
    assert spread(one, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100, numPartitions=20)
    assert spread(many, "id") is many


def test_article_columns():
    assert ARTICLE_COLUMNS == ("Headline", "Description", "Topic_Tags", "PESTLE_Category")


@pytest.mark.parametrize("end,block_bytes", [("\n", 100), ("\r\n", 700), ("\n", 10_000)])
def test_one_file_in_many_tasks(spark, folder, end, block_bytes):
    """Records that go over lines and over several blocks, as the reader of whole files has them."""
    rng = random.Random(block_bytes)
    bits = ["plain", 'a "quote"', "two\nlines", "\n", "\n\n", ",", '""', "é日本", " blank ", "NA", "x" * 300, '"\n"']
    rows = [
        ["".join(rng.choices(bits, k=rng.randrange(4))) for _ in range(3)] for _ in range(120)
    ] + [["long " + "line\n" * 400, "b", "c"]]
    for part in range(2):
        with open(f"{folder}/part-{part}.csv", "w", newline="") as out:
            writer = plain_csv.writer(out, lineterminator=end, quoting=rng.choice([plain_csv.QUOTE_MINIMAL, plain_csv.QUOTE_ALL]))
            writer.writerow(["Head", "a b", 'q"x'])
            writer.writerows(rows[part::2])
    want = csv.read_csv(spark, folder)
    got = csv.land_csv(spark, folder, f"{folder}-landed", block_bytes)
    assert got.columns == want.columns == ["Head", "a b", 'q"x']
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with Scratch(spark) as scratch:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block_bytes))
        try:
            records = csv.split_records(spark, folder, scratch)
            assert records.count() == records.select("file", "number").distinct().count()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_split_reader_on_small_files(spark, folder):
    for name, text in (("none", ""), ("head", "a,b\n"), ("one", 'a,b\n"1\n2",3')):
        (path := pathlib.Path(folder, name)).mkdir()
        (path / "f.csv").write_text(text)
    assert csv.land_csv(spark, f"{folder}/head", f"{folder}/1").columns == ["a", "b"]
    assert [tuple(r) for r in csv.land_csv(spark, f"{folder}/one", f"{folder}/2").collect()] == [("1\n2", "3")]
    with pytest.raises(ValueError, match="no header"):
        csv.land_csv(spark, f"{folder}/none", f"{folder}/3")


def test_split_query_reads_one_file_in_many_tasks(spark):
    path = new_path(spark, "csv")
    csv.write_csv(queries.articles(spark, "/root/testdata/sf0.001").coalesce(1), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(queries.CSV_BLOCK))
    try:
        lines = spark.read.option("lineSep", "\n").text(path)
        assert len(lines.inputFiles()) == 1
        assert lines.select(F.spark_partition_id()).distinct().count() >= 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_large_sources_have_larger_blocks(spark, folder):
    """The number of blocks, and with it what all tasks report to the driver, stays bounded."""
    for part in range(2):
        write(pathlib.Path(folder, f"{part}.csv"), "a,b\n" + '"x\ny",2\n' * 5_000)
    total = stored_bytes(spark, folder)
    assert total == stored_bytes(spark, f"{folder}/*.csv") == 2 * (4 + 8 * 5_000)
    size = csv.block_size(spark, folder, 100)
    assert 100 < size and -(-total // size) <= csv.MANY_BLOCKS
    assert csv.block_size(spark, folder, 1_000) == 1_000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert csv.block_size(spark, folder, 100) == 200
        assert csv.block_size(spark, folder, 1_000) == 1_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    landed = csv.land_csv(spark, folder, f"{folder}-landed", 100)
    assert [tuple(r) for r in landed.groupBy("a", "b").count().collect()] == [("x\ny", "2", 10_000)]


def test_split_query_writes_a_large_table_by_many_tasks(spark, folder, monkeypatch):
    rows = [(i, None if i % 9 == 0 else f'head "{i}"\nline,\n{"x" * i}', "en", f"src{i % 3}", i) for i in range(400)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.repartition(8).write.parquet(f"{folder}/documents.parquet")
    total = stored_bytes(spark, f"{folder}/documents.parquet")
    monkeypatch.setattr(queries, "CSV_FILE", -(-total // 4))
    before = set(glob.glob(f"{shared_dir(spark)}/articles-csv-*/part-*"))
    got = queries.csv_split(spark, folder)
    written = set(glob.glob(f"{shared_dir(spark)}/articles-csv-*/part-*")) - before
    assert len(written) == 4
    assert sorted(map(str, got.collect())) == sorted(map(str, queries.csv_articles(spark, folder).collect()))
