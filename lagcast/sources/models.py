"""Fitted pipelines on shared storage."""

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from lagcast.operators.trees import load
from lagcast.operators.wide_model import save_pipeline
from lagcast.sources.storage import publish, published


def save_model(model: PipelineModel, path: str) -> None:
    """Write a fitted pipeline in place of what is there; readers find the old one or the new one."""
    publish(SparkSession.active(), path, lambda to: save_pipeline(model, to))


def load_model(path: str) -> PipelineModel:
    """Read a fitted pipeline; a missing one is an error at once, not a wait."""
    spark = SparkSession.active()
    return load(spark, published(spark, path) or path)
