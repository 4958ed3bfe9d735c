"""A fitted pipeline and its metadata, stored under a name."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

DEFAULT_NAME = "news_model"


def save_model(
    spark: SparkSession, model: PipelineModel, metadata: dict, root: str, name: str = DEFAULT_NAME
) -> str:
    """Write both parts, replacing an earlier model of that name; returns the folder."""
    folder = f"{root}/{name}"
    model.write().overwrite().save(f"{folder}/model")
    one_row = spark.createDataFrame([(json.dumps(metadata, indent=2),)], "value string")
    one_row.coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")
    return folder


def load_model(
    spark: SparkSession, root: str, name: str = DEFAULT_NAME
) -> tuple[PipelineModel, dict]:
    folder = f"{root}/{name}"
    try:
        stored = spark.read.text(f"{folder}/metadata", wholetext=True)
    except AnalysisException as error:
        raise FileNotFoundError(f"no model at {folder}") from error
    lines = [row.value for row in stored.where("length(value) > 0").collect()]
    return PipelineModel.load(f"{folder}/model"), json.loads("".join(lines))
