"""Model comparison over a long ``(model, metric, value)`` table.

The table has models x metrics rows, so its windows are small by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from flowlens import fixed_values as fv
from flowlens.functions.lookup import lookup


def long_metrics(quality: DataFrame, metrics: list[str] = fv.QUALITY_METRICS) -> DataFrame:
    return quality.select("model", *[F.col(m).cast("double") for m in metrics]).unpivot(
        ["model"], metrics, "metric", "value")


def rank_per_metric(long: DataFrame) -> DataFrame:
    """Rank 1 is the highest value; ties go to the model name."""
    w = Window.partitionBy("metric").orderBy(F.desc("value"), "model")
    return long.select("metric", "model", "value", F.row_number().over(w).cast("bigint").alias("rank"))


def overall_rank(long: DataFrame) -> DataFrame:
    mean = rank_per_metric(long).groupBy("model").agg(F.avg("rank").alias("mean_rank"))
    w = Window.partitionBy(F.lit(0)).orderBy("mean_rank", "model")  # one row per model
    return mean.withColumn("overall_rank", F.row_number().over(w).cast("bigint"))


def best_models(long: DataFrame) -> DataFrame:
    """Best model per metric, plus the overall best under the metric ``overall``."""
    per = rank_per_metric(long).filter("rank = 1").select("metric", "model")
    top = overall_rank(long).filter("overall_rank = 1").select(F.lit("overall").alias("metric"), "model")
    return per.unionByName(top)


def strengths(long: DataFrame, margin: float = 0.1) -> DataFrame:
    """``High <metric>`` / ``Low <metric>`` where a model is 10% off the average."""
    avg = F.avg("value").over(Window.partitionBy("metric"))
    note = (
        F.when(F.col("value") > F.col("__a") * (1 + margin), F.concat(F.lit("High "), "metric"))
        .when(F.col("value") < F.col("__a") * (1 - margin), F.concat(F.lit("Low "), "metric")))
    return long.withColumn("__a", avg).select("model", "metric", note.alias("note")).filter("note is not null")


def metric_statistics(long: DataFrame) -> DataFrame:
    v = F.col("value")
    return long.groupBy("metric").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        (F.max(v) - F.min(v)).alias("range"))


def consistency(long: DataFrame) -> DataFrame:
    """Coefficient of variation per model; lower is steadier."""
    m, s = F.avg("value"), F.stddev_pop("value")
    return long.groupBy("model").agg(
        F.when(m > 0, s / m).otherwise(0.0).alias("consistency"), m.alias("mean"), s.alias("std"))


def ensemble_recommendation(long: DataFrame, scale: float = 0.01, threshold: float = 0.01) -> DataFrame:
    """Mean variance over metrics, taken on fractions, against the threshold."""
    per = long.groupBy("metric").agg(F.var_pop(F.col("value") * scale).alias("v"))
    return per.agg(F.avg("v").alias("avg_variance")).withColumn(
        "ensemble_recommended", F.col("avg_variance") > threshold)


def overview(long: DataFrame) -> DataFrame:
    """Average of every metric and the variance over all values."""
    avgs = [F.avg(F.when(F.col("metric") == m, F.col("value"))).alias(f"avg_{m}") for m in fv.QUALITY_METRICS]
    return long.agg(*avgs, F.var_pop("value").alias("performance_variance"))


def performance_summary(long: DataFrame) -> DataFrame:
    """Best and worst model, average and range per metric; ties go to the model name."""
    high = F.struct((-F.col("value")).alias("v"), F.col("model"))
    low = F.struct(F.col("value").alias("v"), F.col("model"))
    return long.groupBy("metric").agg(
        F.min(high)["model"].alias("best_model"), F.min(low)["model"].alias("worst_model"),
        F.avg("value").alias("average"), (F.max("value") - F.min("value")).alias("range"))


def executive_summary(long: DataFrame) -> DataFrame:
    best = overall_rank(long).filter("overall_rank = 1").select(F.col("model").alias("best_performing_model"))
    numbers = F.struct(F.avg(F.when(F.col("metric") == "accuracy", F.col("value"))).alias("a"),
                       F.var_pop("value").alias("v"))
    s = long.agg(numbers.alias("s")).scalar()
    return best.withColumns({"average_accuracy": s["a"], "performance_variance": s["v"]})


def technical_details(counts: DataFrame, model_types: dict[str, str], feature_count: int) -> DataFrame:
    return counts.select(
        "model", lookup(model_types, F.col("model"), "Unknown").alias("model_type"),
        F.lit(feature_count).alias("feature_count"), F.col("total_samples").alias("training_samples"),
        "threats_detected", "actual_threats", "false_positives", "false_negatives")


def chart_series(long: DataFrame) -> DataFrame:
    """One row per model: metrics as columns, overall rank and consistency."""
    wide = long.groupBy("model").pivot("metric", fv.QUALITY_METRICS).agg(F.first("value"))
    return wide.join(overall_rank(long).select("model", "overall_rank"), "model").join(
        consistency(long).select("model", "consistency"), "model")


def export_sections(long: DataFrame, counts: DataFrame, model_types: dict[str, str],
                    feature_count: int) -> dict[str, DataFrame]:
    """The three tidy tables of the comparison export."""
    return {
        "performance": long.groupBy("model").pivot("metric", fv.QUALITY_METRICS).agg(F.first("value")),
        "ranking": overall_rank(long).select("model", "overall_rank"),
        "technical": technical_details(counts, model_types, feature_count).select(
            "model", "model_type", "feature_count", "training_samples", "threats_detected", "actual_threats"),
    }


