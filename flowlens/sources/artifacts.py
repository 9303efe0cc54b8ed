"""Stored fitted state: statistics, Spark ML models and a run manifest."""

from __future__ import annotations

import json
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F


def save_stats(spark: SparkSession, stats: dict[str, Any], path: str) -> None:
    """Fitted numbers (scaler ranges, means, weights) as one JSON row."""
    spark.range(1).select(F.lit(json.dumps(stats)).alias("stats")).write.json(path)


def load_stats(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.schema("stats string").json(path).first()["stats"])


def save_models(spark: SparkSession, models: dict[str, PipelineModel], path: str,
                info: dict[str, Any] | None = None) -> None:
    """Each model under its name plus a manifest table with one row per model."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/models/{name}")
    rows = [(name, type(m.stages[-1]).__name__, json.dumps((info or {}).get(name, {})))
            for name, m in models.items()]
    spark.createDataFrame(rows, "model string, kind string, info string").write.mode(
        "overwrite").json(f"{path}/manifest")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("model string, kind string, info string").json(f"{path}/manifest")


def load_models(spark: SparkSession, path: str) -> dict[str, PipelineModel]:
    names = [r["model"] for r in load_manifest(spark, path).select("model").collect()]
    return {n: PipelineModel.load(f"{path}/models/{n}") for n in names}
