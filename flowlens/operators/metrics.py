"""Evaluation metrics.

The only pass over the scored rows is ``confusion``: the distinct combinations
of truth and predictions are counted first (at most classes^(models+1) rows),
then unpivoted to one table per model.  All other metrics read that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowlens import fixed_values as fv
from flowlens.functions.lookup import lookup
from flowlens.functions.numeric import safe_div
from flowlens.operators.alerts import BENIGN_IDX, class_name
from flowlens.sources.tables import PREDICTION_COLUMNS


def confusion(df: DataFrame, truth: str = "label_idx", predictions: dict[str, str] = PREDICTION_COLUMNS,
              weight: str | None = None) -> DataFrame:
    """``(model, y_true, y_pred, n)``."""
    cols = list(predictions.values())
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    combos = df.groupBy(truth, *cols).agg(n.alias("n"))
    calls = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("int").alias("y_pred"))
                      for m, c in predictions.items()])
    return (
        combos.select(F.col(truth).cast("int").alias("y_true"), "n", F.inline(calls))
        .groupBy("model", "y_true", "y_pred").agg(F.sum("n").alias("n"))
    )


def per_class(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per (model, class); 0 where undefined."""
    sides = conf.select("model", "n", "y_true", "y_pred", F.explode(
        F.array_distinct(F.array("y_true", "y_pred"))).alias("class_idx"))
    hit = F.col("class_idx") == F.col("y_true")
    called = F.col("class_idx") == F.col("y_pred")
    counts = sides.groupBy("model", "class_idx").agg(
        F.sum(F.when(hit & called, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(called, F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("support"),
    )
    return counts.select(
        "model", "class_idx", class_name(F.col("class_idx")).alias("class_name"),
        safe_div(F.col("tp"), F.col("predicted")).alias("precision"),
        safe_div(F.col("tp"), F.col("support")).alias("recall"),
        safe_div(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1_score"),
        "support",
    )


def averages(classes: DataFrame) -> DataFrame:
    """Macro and support-weighted averages as extra rows of the class report."""
    names = ["precision", "recall", "f1_score"]
    n = F.sum("support")
    macro = classes.groupBy("model").agg(*[F.avg(c).alias(c) for c in names], n.alias("support"))
    weighted = classes.groupBy("model").agg(
        *[safe_div(F.sum(F.col(c) * F.col("support")), n).alias(c) for c in names], n.alias("support"))
    tag = lambda d, t: d.select("model", F.lit(t).alias("class_name"), *names, "support")
    return tag(macro, "macro avg").unionByName(tag(weighted, "weighted avg"))


def class_report(conf: DataFrame) -> DataFrame:
    classes = per_class(conf)
    return classes.drop("class_idx").unionByName(averages(classes))


def quality(conf: DataFrame) -> DataFrame:
    """Accuracy and weighted precision, recall, F1 per model, in percent."""
    acc = conf.groupBy("model").agg(
        (F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)) * 100.0 / F.sum("n")).alias("accuracy"))
    avg = averages(per_class(conf)).filter("class_name = 'weighted avg'").select(
        "model", *[(F.col(c) * 100).alias(c) for c in ("precision", "recall", "f1_score")])
    return acc.join(avg, "model")


def binary_counts(conf: DataFrame) -> DataFrame:
    """TP/FP/TN/FN of threat against benign per model."""
    t, p = F.col("y_true") != BENIGN_IDX, F.col("y_pred") != BENIGN_IDX
    add = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return conf.groupBy("model").agg(
        add(t & p).alias("true_positives"), add(~t & ~p).alias("true_negatives"),
        add(~t & p).alias("false_positives"), add(t & ~p).alias("false_negatives"),
        F.sum("n").alias("total_samples"),
    ).withColumns({
        "threats_detected": F.col("true_positives") + F.col("false_positives"),
        "actual_threats": F.col("true_positives") + F.col("false_negatives"),
    })


def binary_rates(counts: DataFrame) -> DataFrame:
    """Specificity, error rates and detection rate in percent."""
    tp, tn = F.col("true_positives"), F.col("true_negatives")
    fp, fn = F.col("false_positives"), F.col("false_negatives")
    pct = lambda a, b: safe_div(a * 100.0, b)
    return counts.withColumns({
        "specificity": pct(tn, tn + fp), "false_positive_rate": pct(fp, fp + tn),
        "false_negative_rate": pct(fn, fn + tp), "detection_rate": pct(tp, tp + fn),
    })


def efficiency(counts: DataFrame) -> DataFrame:
    tp, tn = F.col("true_positives"), F.col("true_negatives")
    return counts.withColumns({
        "detection_efficiency": safe_div(tp * 100.0, F.col("actual_threats")),
        "precision_efficiency": safe_div(tp * 100.0, F.col("threats_detected")),
        "overall_efficiency": safe_div((tp + tn) * 100.0, F.col("total_samples")),
    })


def evaluation_risk(counts: DataFrame) -> DataFrame:
    """Risk of relying on a model: detections per threat plus both error shares."""
    n = F.col("total_samples").cast("double")
    raw = (
        F.try_divide(F.col("threats_detected").cast("double"), F.col("actual_threats")) * 0.5
        + F.col("false_positives") / n * 0.3 + F.col("false_negatives") / n * 0.2)
    score = F.when(F.col("actual_threats") > 0, raw).otherwise(0.0)
    level = F.when(score < 0.3, "Low").when(score < 0.6, "Medium").otherwise("High")
    return counts.withColumn("risk_score", score).withColumn("risk_level", level)


def threat_distribution(conf: DataFrame) -> DataFrame:
    """Predicted threats per (model, class) with severity points; benign left out."""
    by_class = conf.filter(F.col("y_pred") != BENIGN_IDX).groupBy("model", "y_pred").agg(F.sum("n").alias("n"))
    name = class_name(F.col("y_pred"))
    return by_class.select("model", name.alias("class_name"), "n",
                           (F.col("n") * lookup(fv.EVALUATION_WEIGHTS, name, 0)).alias("points"))


def severity_score(distribution: DataFrame) -> DataFrame:
    total = distribution.groupBy("model").agg(F.sum("points").alias("severity_score"))
    s = F.col("severity_score")
    return total.withColumn("severity", F.when(s > 100, "High").when(s > 50, "Medium").otherwise("Low"))


def timing(df: DataFrame, column: str = "detection_time", by: list[str] | None = None) -> DataFrame:
    t = F.col(column)
    return df.groupBy(*(by or [])).agg(
        F.avg(t).alias("avg_detection_time"), F.min(t).alias("min_detection_time"),
        F.max(t).alias("max_detection_time"), F.stddev_pop(t).alias("detection_time_std"))


def evaluate(df: DataFrame, truth: str = "label_idx",
             predictions: dict[str, str] = PREDICTION_COLUMNS) -> DataFrame:
    """Everything above in one row per model."""
    conf = confusion(df, truth, predictions)
    counts = evaluation_risk(efficiency(binary_rates(binary_counts(conf))))
    return quality(conf).join(counts, "model").join(severity_score(threat_distribution(conf)), "model", "left")


def batch_summary(conf: DataFrame) -> DataFrame:
    """Detection run per model: accuracy, threats and benign counts, run risk."""
    n = F.col("total_samples").cast("double")
    acc = conf.groupBy("model").agg(
        (F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    score = F.col("threats_detected") / n
    return acc.join(binary_counts(conf), "model").select(
        "model", "accuracy", "threats_detected", "actual_threats",
        (F.col("true_negatives") + F.col("false_negatives")).alias("benign_predictions"),
        (F.col("true_negatives") + F.col("false_positives")).alias("actual_benign"),
        score.alias("risk_score"),
        F.when(score > 0.5, "High").when(score > 0.1, "Medium").otherwise("Low").alias("risk_level"),
        F.when(F.col("threats_detected") > 0, "High").otherwise("Low").alias("severity"),
    )


def prediction_distribution(conf: DataFrame) -> DataFrame:
    return conf.groupBy("model", "y_pred").agg(F.sum("n").alias("n")).withColumn(
        "attack_label", class_name(F.col("y_pred")))


def run_totals(conf: DataFrame) -> DataFrame:
    """Sum of actual threats and mean accuracy over the models."""
    return batch_summary(conf).agg(
        F.sum("actual_threats").alias("total_threats"), F.avg("accuracy").alias("mean_accuracy"))


def agreement(df: DataFrame) -> DataFrame:
    """Vote agreement over a batch of enriched alerts."""
    v, n = F.col("threat_votes"), F.count(F.lit(1))
    return df.agg(
        n.alias("total_flows"), F.count_if(F.col("ensemble") == 1).alias("threats_detected"),
        safe_div(F.count_if(F.col("ensemble") == 1) * 100.0, n).alias("detection_rate"),
        F.count_if(v >= 2).alias("model_agreements"), F.count_if(v == 1).alias("model_disagreements"),
        F.count_if((F.col("ensemble") == 0) & (v == 1)).alias("low_risk_flows"),
    )
