"""Aggregations, windows, sorts and set operations over flows and scored models (A, W, T, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import fixed_values as fv
from flowlens.operators import (
    alerts as al, balance as bl, clean as cl, compare as cp, encode as en, fuzzy as fz, metrics as mt, reports as rp,
    sampling as sp, severity as sv,
)
from flowlens.functions import stats as st
from flowlens.queries import query
from flowlens.queries import sql as S
from flowlens.queries.scans import (
    DIRTY, FINITE, FREQ_SQL, MODEL_TYPES, QUALITY_SQL, RISK_SQL, dirty, newest, packet_summary,
)
from flowlens.sources import tables as tb


def rounded(df, *cols, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def conf(spark, sf):
    return mt.confusion(tb.flows(spark, sf))


def long(spark, sf):
    return cp.long_metrics(mt.quality(conf(spark, sf)))


# --- class distribution ---------------------------------------------------------------
@query("a01_class_distribution", f"""WITH {S.FLOWS}
SELECT label_idx, count(*) AS n, round(count(*) * 100.0e0 / sum(count(*)) OVER (), 6) AS pct FROM flows GROUP BY 1""")
def a01(spark, sf):
    return rounded(bl.class_counts(tb.flows(spark, sf), "label_idx"), "pct")


@query("a02_class_weights", f"""WITH {S.FLOWS}
SELECT label_idx, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM flows GROUP BY 1""")
def a02(spark, sf):
    return rounded(bl.class_weights(tb.flows(spark, sf), "label_idx"), "weight")


@query("a03_imbalance", f"""WITH {S.FLOWS}, c AS (SELECT count(*) AS n FROM flows GROUP BY label_idx)
SELECT max(n) AS max_count, min(n) AS min_count, round(max(n) / min(n), 6) AS imbalance_ratio, round(min(n) / max(n), 6) AS balance_ratio,
  max(n) / min(n) > 5 AS imbalanced, max(n) / min(n) > 10 AS severe, min(n) / max(n) > 0.9 AS balanced FROM c""")
def a03(spark, sf):
    return rounded(bl.imbalance(tb.flows(spark, sf), "label_idx"), "imbalance_ratio", "balance_ratio")


@query("a04_distinct_rows", """SELECT l_returnflag, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) GROUP BY 1""")
def a04(spark, sf):
    li = tb.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return li.dropDuplicates().groupBy("l_returnflag").agg(F.count("*").alias("n"))


_STAT = {"flow_duration": 4, "packet_length_mean": 4, "flow_bytes_per_s": 3}


@query("a05_column_moments", f"WITH {S.FLOWS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg({c}), {d}) AS mean, round(stddev_samp({c}), {d}) AS std, min({c}) AS lo, max({c}) AS hi FROM flows"
    for c, d in _STAT.items()))
def a05(spark, sf):
    one = tb.flows(spark, sf).agg(*[x.alias(n) for n, x in st.moments(list(_STAT)).items()])
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.round(f"{c}__mean", d).alias("mean"), F.round(f"{c}__std", d).alias("std"),
        F.col(f"{c}__min").alias("lo"), F.col(f"{c}__max").alias("hi")) for c, d in _STAT.items()])))


_DISTINCT = ["l_returnflag", "l_linestatus", "l_partkey", "l_suppkey", "l_quantity"]


@query("a06_distinct_counts", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n FROM lineitem" for c in _DISTINCT))
def a06(spark, sf):
    one = tb.table(spark, sf, "lineitem").agg(*[F.count_distinct(c).alias(c) for c in _DISTINCT])
    return one.unpivot([], _DISTINCT, "column_name", "n")


# --- evaluation metrics ------------------------------------------------------------------
@query("a07_confusion", f"WITH {S.SCORED} SELECT model, y_true, y_pred, count(*) AS n FROM scored GROUP BY ALL")
def a07(spark, sf):
    return conf(spark, sf)


@query("a08_quality", f"""WITH {QUALITY_SQL} SELECT model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1_score, 6) AS f1_score FROM quality""")
def a08(spark, sf):
    return rounded(mt.quality(conf(spark, sf)), *fv.QUALITY_METRICS)


@query("a09_class_report", f"""WITH {S.LABELS}, {QUALITY_SQL}
SELECT model, name AS class_name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
  CAST(supp AS BIGINT) AS support FROM pm JOIN labels9 ON c = idx
UNION ALL SELECT model, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6), CAST(sum(supp) AS BIGINT) FROM pm GROUP BY model
UNION ALL SELECT model, 'weighted avg', round(sum(precision * supp) / sum(supp), 6), round(sum(recall * supp) / sum(supp), 6),
  round(sum(f1_score * supp) / sum(supp), 6), CAST(sum(supp) AS BIGINT) FROM pm GROUP BY model""")
def a09(spark, sf):
    return rounded(mt.class_report(conf(spark, sf)), "precision", "recall", "f1_score")


@query("a10_binary_rates", f"""WITH {QUALITY_SQL}
SELECT model, tp AS true_positives, tn AS true_negatives, fp AS false_positives, fn AS false_negatives, n AS total_samples,
  tp + fp AS threats_detected, tp + fn AS actual_threats, round(100.0e0 * tn / (tn + fp), 6) AS specificity,
  round(100.0e0 * fp / (fp + tn), 6) AS false_positive_rate, round(100.0e0 * fn / (fn + tp), 6) AS false_negative_rate,
  round(100.0e0 * tp / (tp + fn), 6) AS detection_rate FROM bin""")
def a10(spark, sf):
    return rounded(mt.binary_rates(mt.binary_counts(conf(spark, sf))), "specificity", "false_positive_rate",
                   "false_negative_rate", "detection_rate")


@query("a11_detection_time", f"""WITH {S.ALERTS}
SELECT label_idx, round(avg(detection_time), 6) AS avg_detection_time, min(detection_time) AS min_detection_time,
  max(detection_time) AS max_detection_time, round(stddev_pop(detection_time), 6) AS detection_time_std FROM alerts0 GROUP BY 1""")
def a11(spark, sf):
    return rounded(mt.timing(tb.alerts(spark, sf), by=["label_idx"]), "avg_detection_time", "detection_time_std")


@query("a12_efficiency", f"""WITH {QUALITY_SQL} SELECT model, round(100.0e0 * tp / (tp + fn), 6) AS detection_efficiency,
  round(100.0e0 * tp / (tp + fp), 6) AS precision_efficiency, round(100.0e0 * (tp + tn) / n, 6) AS overall_efficiency FROM bin""")
def a12(spark, sf):
    names = ["detection_efficiency", "precision_efficiency", "overall_efficiency"]
    return rounded(mt.efficiency(mt.binary_counts(conf(spark, sf))).select("model", *names), *names)


_RISK = "((tp + fp) / (tp + fn) * 0.5e0 + fp / n * 0.3e0 + fn / n * 0.2e0)"


@query("a13_evaluation_risk", f"""WITH {QUALITY_SQL} SELECT model, round({_RISK}, 6) AS risk_score,
  CASE WHEN {_RISK} < 0.3 THEN 'Low' WHEN {_RISK} < 0.6 THEN 'Medium' ELSE 'High' END AS risk_level FROM bin""")
def a13(spark, sf):
    return rounded(mt.evaluation_risk(mt.binary_counts(conf(spark, sf))).select("model", "risk_score", "risk_level"), "risk_score")


_W = S.values("w", ["cls", "points"], list(fv.EVALUATION_WEIGHTS.items()))
_DIST = f"""{_W}, {S.LABELS}, {S.SCORED}, dist AS (SELECT model, name AS class_name, count(*) AS n FROM scored JOIN labels9 ON y_pred = idx
  WHERE y_pred <> 1 GROUP BY 1, 2)"""


@query("a14_threat_distribution", f"""WITH {_DIST} SELECT model, class_name, n, n * points AS points,
  CAST(sum(n * points) OVER (PARTITION BY model) AS BIGINT) AS severity_score,
  CASE WHEN sum(n * points) OVER (PARTITION BY model) > 100 THEN 'High' WHEN sum(n * points) OVER (PARTITION BY model) > 50 THEN 'Medium' ELSE 'Low' END AS severity
FROM dist JOIN w ON class_name = cls""")
def a14(spark, sf):
    d = mt.threat_distribution(conf(spark, sf))
    return d.join(mt.severity_score(d), "model")


@query("a15_metric_statistics", f"""WITH {QUALITY_SQL} SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
  round(min(value), 6) AS min, round(max(value), 6) AS max, round(max(value) - min(value), 6) AS range FROM long GROUP BY 1""")
def a15(spark, sf):
    return rounded(cp.metric_statistics(long(spark, sf)), "mean", "std", "min", "max", "range")


@query("a16_consistency", f"""WITH {QUALITY_SQL} SELECT model, round(stddev_pop(value) / avg(value), 6) AS consistency FROM long GROUP BY 1""")
def a16(spark, sf):
    return rounded(cp.consistency(long(spark, sf)).select("model", "consistency"), "consistency")


@query("a17_ensemble_recommended", f"""WITH {QUALITY_SQL}, v AS (SELECT var_pop(value * 0.01) AS v FROM long GROUP BY metric)
SELECT round(avg(v), 9) AS avg_variance, avg(v) > 0.01 AS ensemble_recommended FROM v""")
def a17(spark, sf):
    return rounded(cp.ensemble_recommendation(long(spark, sf)), "avg_variance", digits=9)


@query("a18_metric_overview", f"""WITH {QUALITY_SQL} SELECT round(avg(value) FILTER (metric = 'accuracy'), 6) AS avg_accuracy,
  round(avg(value) FILTER (metric = 'precision'), 6) AS avg_precision, round(avg(value) FILTER (metric = 'recall'), 6) AS avg_recall,
  round(avg(value) FILTER (metric = 'f1_score'), 6) AS avg_f1_score, round(var_pop(value), 6) AS performance_variance FROM long""")
def a18(spark, sf):
    o = cp.overview(long(spark, sf))
    return rounded(o, *o.columns)


@query("a19_performance_summary", f"""WITH {QUALITY_SQL} SELECT metric, arg_max(model, (round(value, 9))) AS best_model,
  arg_min(model, (round(value, 9))) AS worst_model, round(avg(value), 6) AS average, round(max(value) - min(value), 6) AS range FROM long GROUP BY 1""")
def a19(spark, sf):
    return rounded(cp.performance_summary(long(spark, sf)), "average", "range")


# --- reports ---------------------------------------------------------------------------------
@query("a20_risk_report", f"WITH {RISK_SQL} SELECT severity, n, round(percentage, 6) AS percentage, top_attacks, action, description, timeframe FROM risk")
def a20(spark, sf):
    return rounded(rp.risk_report(al.enrich(tb.alerts(spark, sf))), "percentage")


@query("a21_attack_frequency", f"WITH {FREQ_SQL} SELECT attack_type, n, high, medium, low, round(percentage, 6) AS percentage FROM freq")
def a21(spark, sf):
    return rounded(rp.attack_frequency(al.enrich(tb.alerts(spark, sf))), "percentage")


@query("a21_attack_frequency_flows", f"""WITH {S.FLOW_ALERTS}, f AS (SELECT attack_type, count(*) AS n, count(*) FILTER (severity = 'High') AS high,
  count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low FROM alerts
  WHERE {S.VALID} AND attack_type <> 'Benign' GROUP BY 1)
SELECT *, round(n * 100.0e0 / sum(n) OVER (), 6) AS percentage FROM f""")
def a21_flows(spark, sf):
    return rounded(rp.attack_frequency(al.enrich(tb.flows(spark, sf))), "percentage")


@query("a21_frequency_summary", f"""WITH {FREQ_SQL} SELECT CAST(sum(n) AS BIGINT) AS total_attacks, count(*) AS unique_attack_types,
  CAST(sum(high) AS BIGINT) AS high_severity, CAST(sum(medium) AS BIGINT) AS medium_severity, CAST(sum(low) AS BIGINT) AS low_severity,
  (SELECT attack_type FROM freq ORDER BY n DESC, attack_type LIMIT 1) AS most_common,
  (SELECT attack_type FROM freq ORDER BY n, attack_type DESC LIMIT 1) AS least_common FROM freq""")
def a21_summary(spark, sf):
    return rp.attack_frequency_summary(rp.attack_frequency(al.enrich(tb.alerts(spark, sf))))


@query("a22_threat_rate", f"""WITH {S.ALERTS_ENRICHED} SELECT count(*) FILTER ({S.VALID}) AS total_threats, count(*) AS total_flows,
  round(100.0e0 * count(*) FILTER ({S.VALID}) / count(*), 6) AS threat_rate FROM alerts
  WHERE ts >= (SELECT max(ts) FROM alerts) - INTERVAL 30 MINUTES""")
def a22(spark, sf):
    a = tb.alerts(spark, sf)
    return rounded(rp.threat_rate(al.enrich(a), newest(a)), "threat_rate")


_DISPLAY = S.values("disp", ["k", "display"], list(fv.MODEL_DISPLAY_NAMES.items()))
_TOKENS = f"""tok AS (SELECT coalesce(display, trim(m)) AS model FROM (SELECT unnest(string_split(model_used, ',')) AS m FROM alerts WHERE {S.VALID})
  LEFT JOIN disp ON lower(trim(m)) = k)"""


@query("a23_summary", f"""WITH {_DISPLAY}, {S.FLOW_ALERTS}, {_TOKENS}, v AS (SELECT * FROM alerts WHERE {S.VALID})
SELECT 'total' AS item, count(*) AS n FROM v UNION ALL SELECT 'benign', count(*) FILTER (lower(attack_type) LIKE '%benign%') FROM v
UNION ALL SELECT 'malicious', count(*) FILTER (lower(attack_type) NOT LIKE '%benign%') FROM v
UNION ALL SELECT model, count(*) FROM tok GROUP BY 1""")
def a23(spark, sf):
    return rp.summary(al.enrich(tb.flows(spark, sf)))


@query("a31_batch_summary", f"""WITH {QUALITY_SQL} SELECT model, round(accuracy / 100, 6) AS accuracy, tp + fp AS threats_detected, tp + fn AS actual_threats,
  tn + fn AS benign_predictions, tn + fp AS actual_benign, round((tp + fp) / n, 6) AS risk_score,
  CASE WHEN (tp + fp) / n > 0.5 THEN 'High' WHEN (tp + fp) / n > 0.1 THEN 'Medium' ELSE 'Low' END AS risk_level,
  CASE WHEN tp + fp > 0 THEN 'High' ELSE 'Low' END AS severity FROM bin JOIN quality USING (model)""")
def a31(spark, sf):
    return rounded(mt.batch_summary(conf(spark, sf)), "accuracy", "risk_score")


@query("a31_vote_agreement", f"""WITH {S.FLOW_ALERTS} SELECT count(*) AS total_flows, count(*) FILTER (ensemble = 1) AS threats_detected,
  round(100.0e0 * count(*) FILTER (ensemble = 1) / count(*), 6) AS detection_rate, count(*) FILTER (threat_votes >= 2) AS model_agreements,
  count(*) FILTER (threat_votes = 1) AS model_disagreements, count(*) FILTER (ensemble = 0 AND threat_votes = 1) AS low_risk_flows FROM alerts""")
def a31_votes(spark, sf):
    return rounded(mt.agreement(al.enrich(tb.flows(spark, sf))), "detection_rate")


_DT = [("string", 2), ("double", 2), ("int", 0)]


@query("a34_quality_profile", f"""WITH {S.FLOWS}, {DIRTY}, c AS (SELECT count(*) AS n FROM dirty GROUP BY label_idx)
SELECT 'shape' AS section, 'rows' AS item, CAST(count(*) AS DOUBLE) AS value FROM dirty UNION ALL SELECT 'shape', 'columns', 4
UNION ALL SELECT 'features', 'numeric', 2 UNION ALL SELECT 'features', 'categorical', 2
UNION ALL SELECT 'dtype', 'string', 2 UNION ALL SELECT 'dtype', 'double', 2
UNION ALL SELECT 'infinite', 'total', count(*) FILTER (isinf(flow_bytes_per_s)) FROM dirty
UNION ALL SELECT 'missing', 'flow_bytes_per_s', count(*) FILTER (flow_bytes_per_s IS NULL OR isnan(flow_bytes_per_s)) FROM dirty
UNION ALL SELECT 'missing', 'text_number', count(*) FILTER (text_number IS NULL) FROM dirty
UNION ALL SELECT 'class', CAST(label_idx AS VARCHAR), count(*) FROM dirty GROUP BY 2
UNION ALL SELECT 'imbalance', 'ratio', round(max(n) / min(n), 6) FROM c
UNION ALL SELECT 'imbalance', 'severe', CASE WHEN max(n) / min(n) > 10 THEN 1 ELSE 0 END FROM c""")
def a34(spark, sf):
    return rounded(cl.quality_profile(dirty(spark, sf), "label_idx"), "value")


@query("a36_ip_diversity", f"""WITH {S.FLOWS} SELECT count(DISTINCT src_ip || '>' || dst_ip) AS unique_pairs,
  (SELECT count(*) FROM (SELECT src_ip FROM flows UNION SELECT dst_ip FROM flows)) AS unique_ips FROM flows""")
def a36(spark, sf):
    return rp.ip_diversity(tb.flows(spark, sf))


_IND = """avg(flow_bytes_per_s) > 1000000 AS high_byte_rate, avg(flow_packets_per_s) > 1000 AS high_packet_rate,
  avg(flow_duration) < 1 AS short_flow_duration, avg(packet_length_mean) > 1400 AS large_packet_size,
  avg(fin_flag_count + syn_flag_count + rst_flag_count + psh_flag_count + ack_flag_count + urg_flag_count) > 5 AS high_flag_count"""


@query("a37_behavior_indicators", f"WITH {S.FLOWS} SELECT src_ip, {_IND} FROM flows GROUP BY 1")
def a37(spark, sf):
    return sv.behavior_indicators(tb.flows(spark, sf), ["src_ip"])


@query("a37_batch_indicators", f"WITH {S.FLOWS} SELECT {_IND} FROM flows")
def a37_batch(spark, sf):
    return sv.behavior_indicators(tb.flows(spark, sf))


@query("a38_report_status", f"""WITH {S.ALERTS} SELECT count(*) AS n_alerts, epoch_us(max(ts)) AS latest_us,
  round((epoch_us(TIMESTAMP '2030-01-01 00:00:00') - epoch_us(max(ts))) / 60000000, 3) AS age_minutes, true AS is_stale FROM alerts0""")
def a38(spark, sf):
    s = rp.report_status(tb.alerts(spark, sf), F.lit("2030-01-01 00:00:00").cast("timestamp"))
    return s.select("n_alerts", F.unix_micros(F.col("latest").cast("timestamp")).alias("latest_us"),
                    F.round("age_minutes", 3).alias("age_minutes"), "is_stale")


@query("a41_prediction_distribution", f"""WITH {S.LABELS}, {S.SCORED} SELECT model, y_pred, count(*) AS n, any_value(name) AS attack_label
FROM scored JOIN labels9 ON y_pred = idx GROUP BY 1, 2""")
def a41(spark, sf):
    return mt.prediction_distribution(conf(spark, sf))


@query("a42_run_totals", f"""WITH {QUALITY_SQL} SELECT CAST(sum(tp + fn) AS BIGINT) AS total_threats, round(avg(accuracy) / 100, 6) AS mean_accuracy
FROM bin JOIN quality USING (model)""")
def a42(spark, sf):
    return rounded(mt.run_totals(conf(spark, sf)), "mean_accuracy")


@query("a43_executive_summary", f"""WITH {QUALITY_SQL} SELECT (SELECT model FROM overall WHERE overall_rank = 1) AS best_performing_model,
  round(avg(value) FILTER (metric = 'accuracy'), 6) AS average_accuracy, round(var_pop(value), 6) AS performance_variance FROM long""")
def a43(spark, sf):
    return rounded(cp.executive_summary(long(spark, sf)), "average_accuracy", "performance_variance")


@query("a43_technical_details", f"""WITH {QUALITY_SQL} SELECT model, CASE model WHEN 'ACA_SVM' THEN 'LinearSVC' WHEN 'Fuzzy_RF' THEN 'RandomForest' ELSE 'DecisionTree' END AS model_type,
  20 AS feature_count, n AS training_samples, tp + fp AS threats_detected, tp + fn AS actual_threats, fp AS false_positives, fn AS false_negatives FROM bin""")
def a43_technical(spark, sf):
    return cp.technical_details(mt.binary_counts(conf(spark, sf)), MODEL_TYPES, 20)


@query("a44_chart_series", f"""WITH {QUALITY_SQL} SELECT q.model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1_score, 6) AS f1_score, overall_rank, round((SELECT stddev_pop(value) / avg(value) FROM long l WHERE l.model = q.model), 6) AS consistency
FROM quality q JOIN overall o ON q.model = o.model""")
def a44(spark, sf):
    return rounded(cp.chart_series(long(spark, sf)), *fv.QUALITY_METRICS, "consistency")


# --- windows and ranking -----------------------------------------------------------------------
@query("w01_rank_per_metric", f"WITH {QUALITY_SQL} SELECT metric, model, round(value, 6) AS value, rank FROM ranked")
def w01(spark, sf):
    return rounded(cp.rank_per_metric(long(spark, sf)), "value")


@query("w02_overall_rank", f"WITH {QUALITY_SQL} SELECT model, round(mean_rank, 6) AS mean_rank, overall_rank FROM overall")
def w02(spark, sf):
    return rounded(cp.overall_rank(long(spark, sf)), "mean_rank")


@query("w03_best_models", f"""WITH {QUALITY_SQL} SELECT metric, model FROM ranked WHERE rank = 1
UNION ALL SELECT 'overall', model FROM overall WHERE overall_rank = 1""")
def w03(spark, sf):
    return cp.best_models(long(spark, sf))


@query("w04_strengths", f"""WITH {QUALITY_SQL}, a AS (SELECT *, avg(value) OVER (PARTITION BY metric) AS m FROM long)
SELECT model, metric, CASE WHEN value > m * 1.1 THEN 'High ' || metric ELSE 'Low ' || metric END AS note FROM a WHERE value > m * 1.1 OR value < m * 0.9""")
def w04(spark, sf):
    return cp.strengths(long(spark, sf))


@query("w05_top_attacks", f"""WITH {S.ALERTS_ENRICHED}, c AS (SELECT severity, attack_type, count(*) AS n FROM alerts WHERE {S.VALID} GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY n DESC, attack_type) AS rank FROM c) WHERE rank <= 3""")
def w05(spark, sf):
    return rp.top_attacks(rp.severity_attack_counts(al.enrich(tb.alerts(spark, sf))))


@query("w06_running_detection_time", f"""WITH {S.ALERTS_ENRICHED} SELECT flow_id, round(avg(detection_time) OVER (PARTITION BY src_ip
  ORDER BY ts, flow_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 11) AS running_mean FROM alerts
WHERE n_agreeing > 0 AND attack_type <> 'Benign'""")
def w06(spark, sf):
    from flowlens.operators.verify import counted_detections

    counted = counted_detections(al.enrich(tb.alerts(spark, sf)))
    return rounded(rp.running_detection_time(counted, "src_ip").select("flow_id", "running_mean"), "running_mean", digits=11)


@query("w07_dense_codes", """WITH d AS (SELECT DISTINCT l_shipdate AS v FROM lineitem), c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM d)
SELECT CAST(code AS BIGINT) AS code, count(*) AS n FROM lineitem JOIN c ON l_shipdate = v GROUP BY 1""")
def w07(spark, sf):
    return en.encode_column(tb.table(spark, sf, "lineitem").select("l_shipdate"), "l_shipdate", "code").groupBy("code").agg(
        F.count("*").alias("n"))


@query("w07_dense_codes_parallel", """WITH d AS (SELECT DISTINCT l_orderkey AS value FROM lineitem)
SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM d""")
def w07_parallel(spark, sf):
    return en.dense_codes(en.distinct_values(tb.table(spark, sf, "lineitem"), "l_orderkey"))


@query("w09_stratified_split", f"""WITH {S.ALERTS}, r AS (SELECT flow_id, label_idx, row_number() OVER (PARTITION BY label_idx ORDER BY md5(flow_id || '#42')) AS rn,
  count(*) OVER (PARTITION BY label_idx) AS sz FROM alerts0)
SELECT flow_id, label_idx, CASE WHEN rn <= floor(sz * 0.3e0 + 0.5e0) THEN 'test' ELSE 'train' END AS split FROM r""")
def w09(spark, sf):
    return sp.split_exact(tb.alerts(spark, sf).select("flow_id", "label_idx"), "flow_id", "label_idx")


@query("w11_top_features", f"""WITH {S.FLOWS}, k AS (SELECT flow_id, src_port, dst_port, unnest([{', '.join(
    f"{{'name': '{n}', 'v': CAST({c} AS DOUBLE)}}" for n, c in fv.KEY_FEATURES.items() if 'packet_length_mean' not in c)}]) AS f,
  row_number() OVER () AS rid FROM flows),
r AS (SELECT rid, flow_id, f.name AS name, row_number() OVER (PARTITION BY rid ORDER BY abs(f.v) DESC, f.name) AS rn FROM k WHERE abs(f.v) > 0.001)
SELECT top, count(*) AS n FROM (SELECT rid, string_agg(name, '|' ORDER BY rn) AS top FROM r WHERE rn <= 3 GROUP BY 1) GROUP BY 1""")
def w11(spark, sf):
    flows = tb.flows(spark, sf)
    return flows.select(F.array_join(al.top_features(flows), "|").alias("top")).groupBy("top").agg(
        F.count("*").alias("n"))


# --- sorts, limits, sets ---------------------------------------------------------------------------
@query("t01_sorted_frequencies", f"WITH {FREQ_SQL} SELECT attack_type, n, row_number() OVER (ORDER BY n DESC, attack_type) AS position FROM freq")
def t01(spark, sf):
    from pyspark.sql import Window

    freq = rp.attack_frequency(al.enrich(tb.alerts(spark, sf)))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "attack_type")  # one row per attack type
    return freq.select("attack_type", "n", F.row_number().over(w).cast("bigint").alias("position"))


@query("t03_preview", f"WITH {S.ALERTS} SELECT flow_id, epoch_us(ts) AS ts_us FROM alerts0 ORDER BY ts DESC, flow_id LIMIT 20")
def t03(spark, sf):
    return rp.newest_first(tb.alerts(spark, sf)).limit(20).select("flow_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


@query("t04_newest_first", f"WITH {S.ALERTS} SELECT flow_id, label_idx, epoch_us(ts) AS ts_us FROM alerts0 ORDER BY ts DESC, flow_id")
def t04(spark, sf):
    return rp.newest_first(tb.alerts(spark, sf)).select("flow_id", "label_idx", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


@query("t05_random_rows", f"WITH {S.ALERTS} SELECT flow_id, label_idx FROM alerts0 ORDER BY md5(flow_id || '#5') LIMIT 5")
def t05(spark, sf):
    return sp.random_rows(tb.alerts(spark, sf), "flow_id", 5, seed=5).select("flow_id", "label_idx")


@query("u03_unique_models", f"""WITH {_DISPLAY}, {S.ALERTS_ENRICHED}, {_TOKENS} SELECT 'model' AS kind, model AS item FROM (SELECT DISTINCT model FROM tok)
UNION ALL SELECT 'attack', attack_type FROM (SELECT DISTINCT attack_type FROM alerts WHERE {S.VALID})""")
def u03(spark, sf):
    a = al.enrich(tb.alerts(spark, sf))
    return al.unique_models(a).select(F.lit("model").alias("kind"), F.col("model").alias("item")).union(
        al.unique_attack_types(a).select(F.lit("attack"), "attack_type"))


# --- rule-score summaries ------------------------------------------------------------------------------
_FS = """fs AS (SELECT flow_id, least(1, greatest(0, 2 * greatest(
  h1 * 0.3e0 + h2 * 0.25e0 + h3 * 0.2e0 + h4 * 0.15e0 + h5 * 0.1e0 + h6 * 0.2e0 + h7 * 0.15e0, h1, h2, h3, h4, h5, h6, h7))) AS fuzzy_score,
  h1, h2, h3, h4, h5, h6, h7 FROM (SELECT flow_id,
  CASE WHEN flow_packets_per_s > 1000 THEN least(1, (flow_packets_per_s - 1000) / 1000) ELSE 0 END AS h1,
  CASE WHEN flow_bytes_per_s > 1000 THEN least(1, (flow_bytes_per_s - 1000) / 1000) ELSE 0 END AS h2,
  CASE WHEN dst_port <= 1024 THEN least(1, ln(2.0e0) / 10) ELSE 0 END AS h3,
  CASE WHEN flow_duration > 0 THEN least(1, ln(1 + flow_duration) / 10) ELSE 0 END AS h4,
  CASE WHEN packet_length_mean > 0 THEN least(1, ln(1 + packet_length_mean) / 10) ELSE 0 END AS h5,
  CASE WHEN tf > 5 THEN least(1, (tf - 5) / 5) ELSE 0 END AS h6,
  CASE WHEN flow_iat_mean > 0 THEN least(1, ln(1 + flow_iat_mean) / 10) ELSE 0 END AS h7
  FROM (SELECT *, fin_flag_count + syn_flag_count + rst_flag_count + psh_flag_count + ack_flag_count + urg_flag_count AS tf FROM fuzzy_in)))"""
# Rates are scaled down so that the scores spread over the whole range.
FUZZY_SQL = f"""{S.FLOWS}, fuzzy_in AS (SELECT * REPLACE (flow_packets_per_s * 0.5 AS flow_packets_per_s, flow_bytes_per_s / 2000 AS flow_bytes_per_s) FROM flows),
{_FS}"""


def fuzzy_flows(spark, sf):
    f = tb.flows(spark, sf).withColumns({"flow_packets_per_s": F.col("flow_packets_per_s") * 0.5,
                                         "flow_bytes_per_s": F.col("flow_bytes_per_s") / 2000})
    flags = sum([F.col(c) for c in fv.FLAG_COLUMNS[1:]], F.col(fv.FLAG_COLUMNS[0]))
    return f.withColumns({"total_flags": flags, "is_well_known_dst": F.col("dst_port") <= 1024})


@query("a33_fuzzy_summary", f"""WITH {FUZZY_SQL} SELECT round(avg(fuzzy_score), 6) AS mean_score, round(stddev_samp(fuzzy_score), 6) AS std_score,
  round(stddev_pop(fuzzy_score), 6) AS std_pop_score, round(min(fuzzy_score), 6) AS min_score, round(max(fuzzy_score), 6) AS max_score,
  round(median(fuzzy_score), 6) AS median_score, count(*) FILTER (fuzzy_score < 0.2) AS risk_low,
  count(*) FILTER (fuzzy_score >= 0.2 AND fuzzy_score < 0.6) AS risk_medium, count(*) FILTER (fuzzy_score >= 0.6) AS risk_high,
  count(*) FILTER (fuzzy_score > 0.6) AS high_fuzzy FROM fs""")
def a33(spark, sf):
    s = fz.fuzzy_summary(fuzzy_flows(spark, sf).withColumn("fuzzy_score", fz.fuzzy_score(fuzzy_flows(spark, sf))))
    return rounded(s, "mean_score", "std_score", "std_pop_score", "min_score", "max_score", "median_score")


# Synthetic class probabilities derived from the flow columns: three classes share the mass.
PROBS = """probs AS (SELECT flow_id, label_idx, p1, 1 - p1 - p2 AS p3, p2, pred, 5 AS c3, 7 AS c2, fz FROM (SELECT flow_id, label_idx,
  (dst_port % 10) / 10.0e0 AS p1, (1 - (dst_port % 10) / 10.0e0) * ((src_port % 4) / 4.0e0) AS p2,
  CASE WHEN dst_port % 10 >= 5 OR src_port % 3 = 0 THEN 1 ELSE 7 END AS pred, (src_port % 7) / 10.0e0 AS fz FROM flows))"""


def probability_rows(spark, sf):
    """Flows with a probability array over the nine classes, a prediction and a fuzzy score."""
    f = tb.flows(spark, sf).selectExpr(
        "flow_id", "label_idx", "(dst_port % 10) / 10.0D as p1", "(1 - (dst_port % 10) / 10.0D) * ((src_port % 4) / 4.0D) as p2",
        "case when dst_port % 10 >= 5 or src_port % 3 = 0 then 1 else 7 end as pred", "(src_port % 7) / 10.0D as fz")
    zero = F.lit(0.0)
    return f.withColumn("probs", F.array(zero, F.col("p1"), zero, zero, zero, 1 - F.col("p1") - F.col("p2"), zero, F.col("p2"), zero))


OVERRIDE = """ov AS (SELECT *, CASE WHEN pred <> 1 THEN pred WHEN p1 < 0.7 THEN
  CASE WHEN greatest(p3, p2, 0) >= p1 * 0.2 THEN best ELSE pred END WHEN fz > 0.3 THEN best ELSE pred END AS final FROM (
  SELECT *, CASE WHEN p3 >= p2 AND p3 > 0 THEN 5 WHEN p2 > 0 THEN 7 ELSE 0 END AS best FROM probs))"""


@query("a40_override_statistics", f"""WITH {S.FLOWS}, {PROBS}, {OVERRIDE} SELECT count(*) FILTER (pred = 1) AS original_benign,
  count(*) FILTER (final = 1) AS final_benign, count(*) FILTER (pred <> 1) AS original_threats, count(*) FILTER (final <> 1) AS final_threats,
  count(*) FILTER (pred <> final) AS overrides FROM ov""")
def a40(spark, sf):
    rows = probability_rows(spark, sf)
    final = fz.override_prediction(F.col("probs"), F.col("pred"), F.col("fz"))
    return fz.override_statistics(rows.withColumn("final", final), "pred", "final")
