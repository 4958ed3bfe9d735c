"""Text classification and prediction analytics on Spark DataFrames."""

from .plans.scoring import predict, score, score_and_log
from .plans.training import ForestParams, TrainedModel, train

__all__ = ["ForestParams", "TrainedModel", "predict", "score", "score_and_log", "train"]
