"""Analyst verification: precision, reliability, efficiency, detection log (W8, A24-A32, A39, M19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import fixed_values as fv
from flowlens.operators import alerts as al, verify as vf
from flowlens.queries import query
from flowlens.queries import sql as S
from flowlens.queries.aggregates import rounded
from flowlens.session import new_path
from flowlens.sources import readers, sinks, tables as tb

BASE = f"{S.VERIFS}, {S.ALERTS_ENRICHED}, ver AS (SELECT a.*, v.is_threat, v.analysis_time FROM alerts a JOIN active v ON a.flow_id = v.flow_id)"


def alerts(spark, sf):
    return al.enrich(tb.alerts(spark, sf))


def verified(spark, sf):
    return vf.verified_alerts(alerts(spark, sf), tb.verifications(spark, sf))


def repeated_events(spark, sf):
    """Several verdict events per key: events keyed by user instead of flow."""
    return tb.table(spark, sf, "events").selectExpr(
        "concat('user_', cast(user_id as string)) as flow_id", "ts as verified_at", "event_id",
        "case when event_id % 5 = 0 then null else event_id % 2 = 0 end as is_threat", "value as analysis_time")


@query("w08_latest_verdict", """SELECT flow_id, is_threat, analysis_time FROM (SELECT 'user_' || user_id AS flow_id,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 = 0 END AS is_threat, value AS analysis_time,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND is_threat IS NOT NULL""")
def w08(spark, sf):
    return vf.active(repeated_events(spark, sf)).select("flow_id", "is_threat", "analysis_time")


_CALLS = " UNION ALL ".join(f"SELECT '{m}' AS model, {c} <> 1 AS p, is_threat FROM {{t}}" for m, c in S.PREDICTIONS)


@query("a24_manual_precision", f"""WITH {BASE}, c AS ({_CALLS.format(t='ver')} UNION ALL SELECT 'Ensemble', ensemble = 1, is_threat FROM ver)
SELECT model, count(*) FILTER (p) AS predicted_positive, count(*) FILTER (p AND is_threat) AS true_confirmed,
  round(count(*) FILTER (p AND is_threat) / count(*) FILTER (p), 6) AS precision FROM c GROUP BY 1""")
def a24(spark, sf):
    return rounded(vf.manual_precision(verified(spark, sf), tb.PREDICTION_COLUMNS), "precision")


@query("a25_precision_coverage", f"""WITH {BASE}, l AS (SELECT a.*, coalesce(v.is_threat, false) AS is_threat FROM alerts a LEFT JOIN active v ON a.flow_id = v.flow_id),
c AS ({_CALLS.format(t='l')}), k AS (SELECT model, count(*) FILTER (p AND is_threat) AS tp, count(*) FILTER (p) AS det FROM c GROUP BY 1)
SELECT model, tp AS true_positives, det AS total_detected, round(100.0e0 * tp / det, 6) AS precision,
  round(100.0e0 * tp / (SELECT count(*) FROM active WHERE is_threat), 6) AS coverage,
  round(196.0e0 * sqrt((tp / det) * (1 - tp / det) / det), 6) AS precision_ci FROM k""")
def a25(spark, sf):
    return rounded(vf.precision_coverage(alerts(spark, sf), tb.verifications(spark, sf), tb.PREDICTION_COLUMNS),
                   "precision", "coverage", "precision_ci")


_REL = f"""WITH {BASE}, c AS (SELECT count(*) AS n, count(*) FILTER (is_threat) AS t, count(*) FILTER (NOT is_threat) AS f,
  count(*) FILTER (is_threat AND ensemble = 1) AS b, count(*) FILTER (NOT is_threat AND ensemble = 0) AS nb,
  count(*) FILTER (ensemble = 1) AS a FROM ver), r AS (SELECT *, t / n AS p, greatest(0.3e0, t / n * 0.7e0) AS e,
  a / n * (t / n) + (1 - a / n) * (1 - t / n) AS ch FROM c)"""


@query("a26_reliability", f"""{_REL} SELECT n AS total_verified, t AS confirmed, f AS rejected, round(100 * p, 6) AS agreement_rate,
  round(100.0e0 * f / n, 6) AS false_positive_rate, round(60 * p + (100 - 100.0e0 * f / n) * 0.4, 6) AS reliability_score,
  CASE WHEN 100 * p >= 70 THEN 'high' WHEN 100 * p >= 50 THEN 'moderate' ELSE 'developing' END AS reliability_level FROM r""")
def a26(spark, sf):
    out = vf.reliability(verified(spark, sf)).drop("kappa_adjusted", "kappa", "kappa_band")
    return rounded(out, "agreement_rate", "false_positive_rate", "reliability_score")


@query("a27_kappa", f"""{_REL} SELECT round((p - e) / (1 - e), 6) AS kappa_adjusted, round(((b + nb) / n - ch) / (1 - ch), 6) AS kappa,
  CASE WHEN (p - e) / (1 - e) >= 0.81 THEN 'Excellent' WHEN (p - e) / (1 - e) >= 0.61 THEN 'Good' WHEN (p - e) / (1 - e) >= 0.41 THEN 'Moderate'
    WHEN (p - e) / (1 - e) >= 0.21 THEN 'Fair' WHEN (p - e) / (1 - e) >= 0 THEN 'Poor' ELSE 'No Agreement' END AS kappa_band FROM r""")
def a27(spark, sf):
    return rounded(vf.reliability(verified(spark, sf)).select("kappa_adjusted", "kappa", "kappa_band"), "kappa_adjusted", "kappa")


_TIMES = f"""{BASE}, tm AS (SELECT CASE WHEN analysis_time BETWEEN 2 AND 300 THEN analysis_time END AS t FROM ver WHERE attack_type <> 'Benign'),
ms AS (SELECT count(*) AS n, count(t) AS k, median(t) AS med, avg(t) AS mean, min(t) AS lo, max(t) AS hi, stddev_pop(t) AS sd FROM tm),
au AS (SELECT coalesce(avg(detection_time), 0.05) AS a, count(*) AS k FROM alerts WHERE n_agreeing > 0 AND attack_type <> 'Benign')"""


@query("a28_manual_time_stats", f"""WITH {_TIMES} SELECT n AS total_verified, k AS samples, round(med, 6) AS median_time, round(mean, 6) AS mean_time,
  lo AS min_time, hi AS max_time, round(sd, 6) AS std_time FROM ms""")
def a28(spark, sf):
    return rounded(vf.manual_time_stats(verified(spark, sf)), "median_time", "mean_time", "std_time")


@query("a29_efficiency", f"""WITH {_TIMES} SELECT round(med, 6) AS median_manual, round(a, 6) AS automated_time, round(med / a, 6) AS efficiency_ratio,
  round(med - a, 6) AS time_saved, round((med - a) * 100 / med, 6) AS time_saved_pct, round(60 / a, 6) AS automated_per_minute,
  round(60 / med, 6) AS manual_per_minute, CASE WHEN med / a >= 100 THEN 'extremely high' WHEN med / a >= 50 THEN 'very high'
  WHEN med / a >= 10 THEN 'high' ELSE 'moderate' END AS efficiency_level FROM ms, au""")
def a29(spark, sf):
    e = vf.efficiency(alerts(spark, sf), verified(spark, sf))
    return rounded(e, *[c for c in e.columns if c != "efficiency_level"])


@query("a29_savings_by_volume", f"""WITH {_TIMES}, vols AS (SELECT unnest([10, 50, 100, 500, 1000]) AS v)
SELECT CAST(v AS INT) AS volume, round(v * a, 6) AS automated_total, round(v * med, 6) AS manual_total, round(v * (med - a), 6) AS saved_seconds,
  round(v * (med - a) / 60, 6) AS saved_minutes, round(v * (med - a) / 3600, 6) AS saved_hours FROM ms, au, vols""")
def a29_volumes(spark, sf):
    s = vf.savings(vf.efficiency(alerts(spark, sf), verified(spark, sf)))
    return rounded(s, *[c for c in s.columns if c != "volume"])


_PANEL = " UNION ALL ".join(
    f"SELECT '{m}' AS model, {c} <> 1 AS pt, {c} = label_idx AS same, true_is_threat AS t, is_threat AS v, "
    f"{c} = label_idx AS named FROM l" for m, c in S.PREDICTIONS)
PANEL_SQL = f"""{BASE}, l AS (SELECT a.*, v.is_threat FROM alerts a LEFT JOIN active v ON a.flow_id = v.flow_id WHERE {S.VALID}),
c AS ({_PANEL}), k AS (SELECT model, count(*) AS total_analyzed, count(*) FILTER (pt AND same) AS d, count(*) FILTER (pt AND same AND v) AS mtp,
  count(*) FILTER (pt AND same AND v = false) AS mfp, count(*) FILTER (pt = t) AS ok, count(*) FILTER (pt AND t) AS tp,
  count(*) FILTER (NOT pt AND NOT t) AS tn, count(*) FILTER (NOT pt AND t) AS fn FROM c GROUP BY 1),
panel AS (SELECT model, total_analyzed, d AS total_detections, mtp AS manual_tp, mfp AS manual_fp, tn AS true_negatives, fn AS false_negatives,
  100.0e0 * ok / d AS overall_accuracy, 100.0e0 * mtp / d AS detection_accuracy, 100.0e0 * tp / (tp + fn) AS true_positive_rate,
  100.0e0 * mfp / d AS false_positive_rate, CASE WHEN ok <= d THEN 196.0e0 * sqrt((ok / d) * (1 - ok / d) / d) END AS ci_margin FROM k)"""
_PANEL_ROUND = ["overall_accuracy", "detection_accuracy", "true_positive_rate", "false_positive_rate", "ci_margin"]


@query("a30_panel_metrics", f"""WITH {PANEL_SQL} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _PANEL_ROUND)}) FROM panel""")
def a30(spark, sf):
    return rounded(vf.panel_metrics(alerts(spark, sf), tb.verifications(spark, sf), tb.PREDICTION_COLUMNS), *_PANEL_ROUND)


@query("s17_panel_export", f"""WITH {PANEL_SQL} SELECT model, round(detection_accuracy, 6) AS detection_accuracy, total_detections, manual_tp, manual_fp FROM panel""")
def s17(spark, sf):
    panel = vf.panel_metrics(alerts(spark, sf), tb.verifications(spark, sf), tb.PREDICTION_COLUMNS)
    path, out = new_path(spark, "panel-csv"), vf.panel_export(panel)
    sinks.write_csv(out, path)
    back = spark.read.option("header", True).schema(out.schema).csv(path)
    names = ["model", "detection_accuracy", "total_detections", "manual_tp", "manual_fp"]
    return rounded(back.toDF(*names), "detection_accuracy")


@query("a39_table_counters", f"""WITH {BASE}, pos AS (SELECT count(*) AS n, count(*) FILTER (lower(trim(model_used)) NOT IN ('', 'unknown', 'simulated')) AS p,
  count(*) FILTER ({S.VALID} AND flow_id NOT IN (SELECT flow_id FROM active)) AS u FROM alerts),
v AS (SELECT count(*) AS n, count(*) FILTER (is_threat) AS t FROM active)
SELECT pos.n AS total_detected, p AS positives, v.n AS total_verified, t AS verified_true, CAST(round(100.0e0 * t / p) AS BIGINT) AS detection_accuracy,
  CAST(round(100.0e0 * t / v.n) AS BIGINT) AS manual_precision, u AS unverified FROM pos, v""")
def a39(spark, sf):
    return vf.table_counters(alerts(spark, sf), tb.verifications(spark, sf))


def detection_log(spark, sf):
    """Detection log of one model written as JSON lines and read back."""
    scored = tb.alerts(spark, sf)
    path = new_path(spark, "detections")
    sinks.append_detections(sinks.detection_log(scored, "ACA_SVM", "pred_aca_svm", "detection_time", ["detection_time"]), path)
    return readers.read_detection_log(spark, path)


def corrections(spark, sf):
    """Two correction events for every seventh flow; the later one counts."""
    e = tb.table(spark, sf, "events").filter("event_id % 7 = 0")
    first = e.selectExpr("concat('flow_', event_id) as flow_id", "ts as corrected_at", "cast((event_id + 1) % 9 as int) as manual_label")
    second = e.selectExpr("concat('flow_', event_id)", "ts + interval 1 hour", "cast(event_id % 9 as int)")
    return first.union(second)


_LOG = f"""{S.ALERTS}, lg AS (SELECT pred_aca_svm AS p, CASE WHEN event_id % 7 = 0 THEN label_idx END AS m FROM alerts0)"""


@query("a32_log_statistics", f"""WITH {_LOG} SELECT count(*) AS total, count(*) FILTER (m IS NULL) AS pending, count(m) AS verified,
  count(*) FILTER (m = p) AS correct, round(count(*) FILTER (m = p) / count(m), 6) AS accuracy FROM lg""")
def a32(spark, sf):
    return rounded(vf.log_statistics(vf.apply_corrections(detection_log(spark, sf), corrections(spark, sf))), "accuracy")


@query("m19_corrected_log", f"""WITH {_LOG}, c AS (SELECT p AS prediction, m AS manual_label, CASE WHEN m IS NULL THEN 'pending' ELSE 'verified' END AS verification_status FROM lg)
SELECT prediction, manual_label, verification_status, count(*) AS n FROM c GROUP BY ALL""")
def m19(spark, sf):
    log = vf.apply_corrections(detection_log(spark, sf), corrections(spark, sf))
    return log.groupBy("prediction", "manual_label", "verification_status").agg(F.count("*").alias("n"))
