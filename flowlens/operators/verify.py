"""Analyst verdicts: current state, precision, reliability, efficiency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens import fixed_values as fv
from flowlens.functions.numeric import safe_div, wald_margin
from flowlens.functions.quantile import exact_quantiles
from flowlens.session import materialize
from flowlens.operators.alerts import class_name, is_benign, is_threat, is_valid_alert


def valid_analysis_time(c: Column) -> Column:
    """Seconds when within 2..300, else NULL; text that is no number is NULL."""
    t = c.try_cast("double")
    return F.when(t.between(2, 300), t)


def arrival(events: DataFrame, order: tuple[str, ...] = ("event_id",)) -> list[str]:
    """Sequence columns that decide between events of equal time, where the events carry them."""
    return [c for c in order if c in events.columns]


def latest(events: DataFrame, key: str = "flow_id", at: str = "verified_at",
           order: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Newest event per key; of events with equal times the one with the largest sequence number.

    An aggregate of structs ordered by time, combined map-side: a key with very
    many events costs one partial row per task, never a sorted window.
    """
    rest = [c for c in events.columns if c not in (key, at)]
    first = arrival(events, order)
    newest = F.max(F.struct(F.col(at), *first, *[c for c in rest if c not in first])).alias("__s")
    return events.groupBy(key).agg(newest).select(key, f"__s.{at}", *[f"__s.{c}" for c in rest])


def active(events: DataFrame) -> DataFrame:
    """Current verdicts; a newest event without verdict withdraws the flow."""
    return latest(events).filter(F.col("is_threat").isNotNull())


def verified_alerts(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts with their active verdict (inner join on the flow key)."""
    return alerts.join(active(events).select("flow_id", "is_threat", "analysis_time"), "flow_id")


def _per_model(alerts: DataFrame, predictions: dict[str, str], extra: list[str]) -> DataFrame:
    """One row per (alert, model) with that model's call, plus the ensemble."""
    calls = [F.struct(F.lit(m).alias("model"), is_threat(F.col(c)).alias("predicted")) for m, c in predictions.items()]
    calls.append(F.struct(F.lit("Ensemble").alias("model"), (F.col("ensemble") == 1).alias("predicted")))
    return alerts.select(*extra, F.inline(F.array(*calls)))


def manual_precision(verified: DataFrame, predictions: dict[str, str]) -> DataFrame:
    """Confirmed share of each model's positives over verified flows."""
    rows = _per_model(verified, predictions, ["is_threat"])
    pos = F.count_if("predicted")
    ok = F.count_if(F.col("predicted") & F.col("is_threat"))
    return rows.groupBy("model").agg(
        pos.alias("predicted_positive"), ok.alias("true_confirmed"), safe_div(ok, pos).alias("precision"))


def precision_coverage(alerts: DataFrame, events: DataFrame, predictions: dict[str, str]) -> DataFrame:
    """Precision over all detections, coverage of confirmed threats, 95% half width."""
    verdicts = active(events).select("flow_id", "is_threat")
    joined = alerts.join(verdicts, "flow_id", "left").withColumn("is_threat", F.coalesce("is_threat", F.lit(False)))
    confirmed = verdicts.agg(F.struct(F.count_if("is_threat").alias("n")).alias("s")).scalar()["n"]
    rows = _per_model(joined, predictions, ["is_threat"]).filter("model <> 'Ensemble'")
    det = F.count_if("predicted")
    tp = F.count_if(F.col("predicted") & F.col("is_threat"))
    out = rows.groupBy("model").agg(tp.alias("true_positives"), det.alias("total_detected"))
    p = safe_div(F.col("true_positives"), F.col("total_detected"))
    return out.withColumns({
        "precision": p * 100, "coverage": safe_div(F.col("true_positives") * 100.0, confirmed),
        "precision_ci": wald_margin(p, F.col("total_detected")) * 100})


def reliability(verified: DataFrame) -> DataFrame:
    """Agreement, false-positive rate, composite score and level, kappa."""
    n, t = F.count(F.lit(1)), F.count_if("is_threat")
    f = n - t
    counts = verified.agg(
        n.alias("total_verified"), t.alias("confirmed"), f.alias("rejected"),
        F.count_if(F.col("is_threat") & (F.col("ensemble") == 1)).alias("both"),
        F.count_if(~F.col("is_threat") & (F.col("ensemble") == 0)).alias("neither"),
        F.count_if(F.col("ensemble") == 1).alias("auto"))
    total = F.col("total_verified")
    rate = safe_div(F.col("confirmed"), total)
    expected = F.greatest(F.lit(0.30), rate * 0.70)
    adjusted = F.when(expected >= 1, 0.0).otherwise((rate - expected) / (1 - expected))
    observed = safe_div(F.col("both") + F.col("neither"), total)
    auto = safe_div(F.col("auto"), total)
    chance = auto * rate + (1 - auto) * (1 - rate)
    agree, fp = rate * 100, safe_div(F.col("rejected") * 100.0, total)
    out = counts.withColumns({
        "agreement_rate": agree, "false_positive_rate": fp,
        "reliability_score": agree * 0.6 + (100 - fp) * 0.4,
        "kappa_adjusted": adjusted, "kappa": F.try_divide(observed - chance, 1 - chance),
    })
    a, k = F.col("agreement_rate"), F.col("kappa_adjusted")
    band = F.when(F.lit(False), "")
    for floor, name in fv.KAPPA_BANDS:
        band = band.when(k >= floor, name)
    return out.withColumns({
        "reliability_level": F.when(a >= 70, "high").when(a >= 50, "moderate").otherwise("developing"),
        "kappa_band": band.otherwise(fv.KAPPA_BELOW),
    }).drop("both", "neither", "auto")


def manual_times(verified: DataFrame) -> DataFrame:
    """Valid analysis times of verified, non-benign alerts."""
    return verified.filter(~is_benign()).withColumn("analysis_time", valid_analysis_time(F.col("analysis_time")))


def manual_time_stats(verified: DataFrame) -> DataFrame:
    t = F.col("analysis_time")
    # Written once: the quantile passes and the moments read one column.
    times = materialize(manual_times(verified).select("analysis_time"), "times")
    median = exact_quantiles(times, {"analysis_time": [0.5]})["analysis_time", 0.5]
    return times.agg(
        F.count(F.lit(1)).alias("total_verified"), F.count(t).alias("samples"),
        F.lit(median).cast("double").alias("median_time"), F.avg(t).alias("mean_time"), F.min(t).alias("min_time"),
        F.max(t).alias("max_time"), F.stddev_pop(t).alias("std_time"))


def counted_detections(alerts: DataFrame) -> DataFrame:
    """Detected, non-benign alerts: the ones whose detection time counts."""
    return alerts.filter((F.col("n_agreeing") > 0) & ~is_benign())


def automated_time(alerts: DataFrame) -> DataFrame:
    """Mean automated time per counted detection, 0.05 s when nothing was timed."""
    return counted_detections(alerts).agg(
        F.coalesce(F.avg("detection_time"), F.lit(fv.DEFAULT_DETECTION_SECONDS)).alias("automated_time"),
        F.count("detection_time").alias("n_timed"))


def efficiency(alerts: DataFrame, verified: DataFrame) -> DataFrame:
    """Automated against manual time; one row."""
    auto = automated_time(alerts).agg(F.first(F.struct("automated_time")).alias("s")).scalar()["automated_time"]
    base = manual_time_stats(verified).select(F.col("median_time").alias("m"), auto.alias("a"))
    m, a = F.col("m"), F.col("a")
    ratio = safe_div(m, a)
    return base.select(
        m.alias("median_manual"), a.alias("automated_time"), ratio.alias("efficiency_ratio"),
        (m - a).alias("time_saved"), safe_div((m - a) * 100, m).alias("time_saved_pct"),
        safe_div(F.lit(60.0), a).alias("automated_per_minute"), safe_div(F.lit(60.0), m).alias("manual_per_minute"),
        F.when(ratio >= 100, "extremely high").when(ratio >= 50, "very high").when(ratio >= 10, "high")
        .otherwise("moderate").alias("efficiency_level"))


def savings(eff: DataFrame, volumes: list[int] = fv.SAVING_VOLUMES) -> DataFrame:
    """Time totals for several alert volumes."""
    v = F.col("volume")
    return eff.select("median_manual", "automated_time", F.explode(F.array(*[F.lit(x) for x in volumes])).alias("volume")).select(
        "volume", (v * F.col("automated_time")).alias("automated_total"), (v * F.col("median_manual")).alias("manual_total"),
        (v * (F.col("median_manual") - F.col("automated_time"))).alias("saved_seconds"),
        (v * (F.col("median_manual") - F.col("automated_time")) / 60).alias("saved_minutes"),
        (v * (F.col("median_manual") - F.col("automated_time")) / 3600).alias("saved_hours"))


def panel_metrics(alerts: DataFrame, events: DataFrame, predictions: dict[str, str]) -> DataFrame:
    """Per-model panel over valid alerts: type-matched detections, verdicts, error counts.

    Where a model has no type-matched detection, accuracy falls back to the
    confirmed share of the verified alerts that name the model.
    """
    verdicts = active(events).select("flow_id", "is_threat")
    valid = alerts.filter(is_valid_alert()).join(verdicts, "flow_id", "left")
    calls = []
    for m, c in predictions.items():
        threat = is_threat(F.col(c))
        calls.append(F.struct(
            F.lit(m).alias("model"), threat.alias("pt"), (class_name(F.col(c)) == F.col("attack_type")).alias("same"),
            F.array_contains("detection_models", m).alias("named")))
    rows = valid.select("is_threat", "true_is_threat", F.inline(F.array(*calls)))
    det = F.col("pt") & F.col("same")
    t, yes, no = F.col("true_is_threat"), F.coalesce("is_threat", F.lit(False)), F.coalesce(~F.col("is_threat"), F.lit(False))
    named = F.col("named") & F.col("is_threat").isNotNull()
    counts = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("total_analyzed"), F.count_if(det).alias("detections"),
        F.count_if(det & yes).alias("manual_tp"), F.count_if(det & no).alias("manual_fp"),
        F.count_if(F.col("pt") == t).alias("correct"), F.count_if(F.col("pt") & t).alias("tp"),
        F.count_if(~F.col("pt") & ~t).alias("true_negatives"), F.count_if(~F.col("pt") & t).alias("false_negatives"),
        F.count_if(named).alias("named_verified"), F.count_if(named & yes).alias("named_confirmed"))
    d = F.col("detections")
    overall = safe_div(F.col("correct"), d)
    fallback = safe_div(F.col("named_confirmed") * 100.0, F.col("named_verified"))
    # The panel divides by type-matched detections, so the share may pass 1; its
    # interval is then undefined and shown as NULL.
    margin = F.when(d > 0, F.when(overall <= 1, wald_margin(overall, d) * 100)).otherwise(0.0)
    return counts.select(
        "model", "total_analyzed", F.when(d > 0, d).otherwise(F.col("named_verified")).alias("total_detections"),
        "manual_tp", "manual_fp", "true_negatives", "false_negatives",
        (overall * 100).alias("overall_accuracy"),
        F.when(d > 0, safe_div(F.col("manual_tp") * 100.0, d)).otherwise(fallback).alias("detection_accuracy"),
        safe_div(F.col("tp") * 100.0, F.col("tp") + F.col("false_negatives")).alias("true_positive_rate"),
        safe_div(F.col("manual_fp") * 100.0, d).alias("false_positive_rate"),
        margin.alias("ci_margin"))


def panel_export(panel: DataFrame) -> DataFrame:
    """Columns of the performance export."""
    return panel.select(
        F.col("model").alias("Model Name"), F.col("detection_accuracy").alias("Detection Accuracy (%)"),
        F.col("total_detections").alias("Total Detections"), F.col("manual_tp").alias("True Positives"),
        F.col("manual_fp").alias("False Positives"))


def table_counters(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Header counters of the alert table; percentages are whole numbers."""
    verdicts = active(events).select("flow_id", "is_threat")
    used = F.lower(F.trim("model_used"))
    positive = ~used.isin("", "unknown", "simulated")
    v = verdicts.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if("is_threat").alias("t")).alias("s")).scalar()
    joined = alerts.join(verdicts.withColumn("__v", F.lit(True)).select("flow_id", "__v"), "flow_id", "left")
    unverified = F.count_if(is_valid_alert() & ~used.isin("", "unknown") & F.col("__v").isNull())
    counts = joined.agg(F.count(F.lit(1)).alias("total_detected"), F.count_if(positive).alias("positives"),
                        unverified.alias("unverified"))
    pct = lambda a, b: F.round(safe_div(a * 100.0, b), 0).cast("bigint")
    return counts.select(
        "total_detected", "positives", v["n"].alias("total_verified"), v["t"].alias("verified_true"),
        pct(v["t"], F.col("positives")).alias("detection_accuracy"),
        pct(v["t"], v["n"]).alias("manual_precision"), "unverified")


# --- detection log ------------------------------------------------------------------
def apply_corrections(log: DataFrame, corrections: DataFrame) -> DataFrame:
    """Detection log with the newest manual label per flow."""
    newest = latest(corrections, "flow_id", "corrected_at").select("flow_id", F.col("manual_label").alias("__l"))
    return log.join(newest, "flow_id", "left").withColumns({
        "verification_status": F.when(F.col("__l").isNotNull(), "verified").otherwise(F.col("verification_status")),
        "manual_label": F.coalesce("__l", "manual_label"),
    }).drop("__l")


def log_statistics(log: DataFrame) -> DataFrame:
    """Totals of the detection log and accuracy over its verified part."""
    ver = F.col("verification_status") == "verified"
    right = F.count_if(ver & (F.col("manual_label") == F.col("prediction")))
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("verification_status") == "pending").alias("pending"),
        F.count_if(ver).alias("verified"), right.alias("correct"),
        safe_div(right, F.count_if(ver)).alias("accuracy"))
