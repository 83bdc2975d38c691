"""Fitted-model storage."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_scorer(scorer: DataFrame, path: str) -> None:
    scorer.write.mode("overwrite").parquet(path)


def load_scorer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
