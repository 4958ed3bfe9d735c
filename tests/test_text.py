"""Text expressions against plain Python."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from sextile.functions import constants
from sextile.functions.text import has_text, is_blank, joined_text, log_text, strip, terms, tokens

PARTS = "h string, d string, t string"


def python_tokens(text):
    words = re.findall(r"\w\w+", text.lower())
    return [w for w in words if w not in constants.ENGLISH_STOP_WORDS]


def python_terms(text):
    words = python_tokens(text)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_stop_words_are_those_of_spark(spark):
    listed = StopWordsRemover.loadDefaultStopWords("english")
    assert tuple(w for w in listed if re.fullmatch(r"\w\w+", w)) == constants.ENGLISH_STOP_WORDS


def test_white_space_is_that_of_python():
    assert set(constants.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_joined_text(spark):
    rows = [
        (None, "", "  "),
        ("A", None, "b"),
        ("\t X\n", "y", "　Z\x1f"),
        (" ", "\x85", None),
    ]
    frame = spark.createDataFrame(rows, PARTS)
    got = frame.select(joined_text("h", "d", "t").alias("x"), has_text("h", "d", "t").alias("k"))
    expected = [
        " ".join(part or "" for part in row).lower().strip() for row in rows
    ]
    assert [r.x for r in got.collect()] == expected == ["", "a  b", "x\n y 　z", ""]
    assert [r.k for r in got.collect()] == [False, True, True, False]
    assert frame.columns == ["h", "d", "t"]


def test_blank_and_log_text(spark):
    long = "😀é" * 300
    frame = spark.createDataFrame([(long,), ("  ",), ("",)], "x string")
    rows = frame.select(log_text("x").alias("kept"), is_blank("x").alias("blank")).collect()
    assert rows[0].kept == long[:500] and len(rows[0].kept) == 500
    assert [r.blank for r in rows] == [False, True, True]


TEXTS = st.lists(
    st.text(st.sampled_from("ab_é7ßЖ 中ñ-'.\n THE the and"), max_size=40), min_size=1, max_size=30
)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXTS)
def test_tokens_terms_and_strip(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    rows = (
        frame.withColumn("w", tokens("x"))
        .select("i", "w", terms("w").alias("t"), strip("x").alias("s"))
        .orderBy("i")
        .collect()
    )
    assert [r.w for r in rows] == [python_tokens(t) for t in texts]
    assert [r.t for r in rows] == [python_terms(t) for t in texts]
    assert [r.s for r in rows] == [t.strip() for t in texts]


def test_own_stop_words(spark):
    frame = spark.createDataFrame([("the cat sat",)], "x string")
    assert frame.select(tokens("x", ["cat"])).first()[0] == ["the", "sat"]
    assert frame.select(tokens("x", [])).first()[0] == ["the", "cat", "sat"]
    assert frame.select(tokens("x", ["don't"])).first()[0] == ["the", "cat", "sat"]
    assert spark.range(1).select(F.lit(None).cast("string").alias("x")).select(
        tokens("x")
    ).first()[0] == []
