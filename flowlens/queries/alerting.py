"""Alert enrichment: severity, risk, impact, actions, texts (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import fixed_values as fv
from flowlens.operators import alerts as al, severity as sv, verify as vf
from flowlens.queries import query
from flowlens.queries import sql as S
from flowlens.queries.aggregates import _IND, rounded
from flowlens.queries.scans import ACT_SQL, EXTRA_SQL, _IMPACT
from flowlens.sources import tables as tb


def flow_alerts(spark, sf):
    return al.enrich(tb.flows(spark, sf))


_SEV = S.values("sev", ["t", "s"], list(fv.THREAT_SEVERITY.items()))


@query("r01_base_severity", f"""WITH {_SEV}, {S.FLOW_ALERTS} SELECT attack_type, coalesce(s, 'Medium') AS base_severity, count(*) AS n
FROM alerts LEFT JOIN sev ON lower(attack_type) = t GROUP BY 1, 2""")
def r01(spark, sf):
    a = flow_alerts(spark, sf)
    return a.select("attack_type", sv.assign_severity(F.col("attack_type")).alias("base_severity")).groupBy(
        "attack_type", "base_severity").agg(F.count("*").alias("n"))


# (indicator, weight * score, weight) of the five extracted indicators
_BW = [("high_byte_rate", 0.25 * 0.9, 0.25), ("high_packet_rate", 0.3 * 0.9, 0.3), ("short_flow_duration", 0.2 * 0.6, 0.2),
       ("large_packet_size", 0.25 * 0.6, 0.25), ("high_flag_count", 0.4 * 0.9, 0.4)]
_BSCORE = "(" + " + ".join(f"CASE WHEN {n} THEN {g!r}::DOUBLE ELSE 0 END" for n, g, _ in _BW) + ") / 1.4e0"
_BLEVEL = f"CASE WHEN {_BSCORE} > 0.7 THEN 'High' WHEN {_BSCORE} > 0.4 THEN 'Medium' ELSE 'Low' END"


@query("r02_behavior_severity", f"""WITH {S.FLOWS}, i AS (SELECT src_ip, {_IND} FROM flows GROUP BY 1)
SELECT src_ip, round({_BSCORE}, 6) AS behavior_score, {_BLEVEL} AS severity FROM i""")
def r02(spark, sf):
    ind = sv.behavior_indicators(tb.flows(spark, sf), ["src_ip"])
    cols = {n: F.col(n) for n in sv.BATCH_INDICATORS}
    return ind.select("src_ip", F.round(sv.behavior_score(cols), 6).alias("behavior_score"),
                      sv.assign_severity(F.lit("any"), cols).alias("severity"))


_RA = S.values("ra", ["k", "v"], [(k, float(v)) for k, v in fv.RISK_ATTACK.items()])
_RISK = f"""{_RA}, {S.FLOW_ALERTS}, rs AS (SELECT attack_type, severity, src_port % 2 = 0 AS ext, dst_port % 3 = 0 AS crit,
  CASE protocol WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE 'icmp' END AS proto FROM alerts),
rk AS (SELECT rs.*, CASE severity WHEN 'Low' THEN 0.2e0 WHEN 'Medium' THEN 0.5e0 ELSE 0.8e0 END * 0.4e0 + CAST(coalesce(v, 0.5) AS DOUBLE) * 0.25e0
  + least(1.0e0, CASE WHEN ext THEN 0.7e0 ELSE 0 END + CASE WHEN crit THEN 0.8e0 ELSE 0 END) * 0.2e0
  + CASE proto WHEN 'tcp' THEN 0.4e0 WHEN 'udp' THEN 0.6e0 ELSE 0.8e0 END * 0.15e0 AS score FROM rs LEFT JOIN ra ON lower(attack_type) = k)"""


def with_risk(spark, sf):
    proto = F.when(F.col("protocol") == 6, "tcp").when(F.col("protocol") == 17, "udp").otherwise("icmp")
    a = flow_alerts(spark, sf)
    score = sv.risk_score(F.col("severity"), F.col("attack_type"), F.col("src_port") % 2 == 0, F.col("dst_port") % 3 == 0, proto)
    return a.withColumn("risk_score", F.round(score, 6))


@query("r03_risk_score", f"WITH {_RISK} SELECT attack_type, severity, round(score, 6) AS risk_score, count(*) AS n FROM rk GROUP BY ALL")
def r03(spark, sf):
    return with_risk(spark, sf).groupBy("attack_type", "severity", "risk_score").agg(F.count("*").alias("n"))


_LEVEL = "CASE WHEN round(score, 6) >= 0.8 THEN 'Critical' WHEN round(score, 6) >= 0.6 THEN 'High' WHEN round(score, 6) >= 0.4 THEN 'Medium' ELSE 'Low' END"


@query("r04_risk_level", f"WITH {_RISK} SELECT {_LEVEL} AS risk_level, count(*) AS n FROM rk GROUP BY ALL")
def r04(spark, sf):
    return with_risk(spark, sf).groupBy(sv.risk_level(F.col("risk_score")).alias("risk_level")).agg(F.count("*").alias("n"))


@query("r05_impact_levels", f"""WITH {_IMPACT}, {S.FLOW_ALERTS} SELECT attack_type, coalesce(a, 'Low') AS operational_impact, coalesce(b, 'Low') AS data_impact,
  coalesce(c, 'Low') AS financial_impact, coalesce(d, 'Low') AS reputation_impact, count(*) AS n FROM alerts LEFT JOIN imp ON lower(attack_type) = k GROUP BY ALL""")
def r05(spark, sf):
    return sv.with_impact(flow_alerts(spark, sf), "attack_type").groupBy(
        "attack_type", *[f"{d}_impact" for d in fv.IMPACT_DIMENSIONS]).agg(F.count("*").alias("n"))


@query("r06_action_plan", f"""WITH {ACT_SQL}, {EXTRA_SQL}, {_RISK}, lv AS (SELECT attack_type, {_LEVEL} AS risk_level FROM rk)
SELECT attack_type, risk_level, im || coalesce(x, '') AS immediate, priority, response_time, count(*) AS n
FROM lv JOIN act ON lv = risk_level LEFT JOIN ext ON lower(attack_type) = k GROUP BY ALL""".replace("JOIN act ON lv =", "JOIN act ON act.lv ="))
def r06(spark, sf):
    a = with_risk(spark, sf).select("attack_type", sv.risk_level(F.col("risk_score")).alias("risk_level"))
    counts = a.groupBy("attack_type", "risk_level").agg(F.count("*").alias("n"))
    return sv.with_actions(counts, "risk_level", "attack_type").select(
        "attack_type", "risk_level", F.array_join("immediate", "|").alias("immediate"), "priority", "response_time", "n")


_SHARES = ", ".join(f"avg(CASE WHEN {c} <> 1 THEN 1.0e0 ELSE 0 END) AS s{i}" for i, (_, c) in enumerate(S.PREDICTIONS))


@query("r07_threat_type", f"""WITH {S.FLOWS}, g AS (SELECT dst_ip, {_SHARES} FROM flows GROUP BY 1)
SELECT dst_ip, CASE WHEN greatest(s0, s1, s2) > 0.8 THEN 'malware' WHEN greatest(s0, s1, s2) > 0.6 THEN 'scan' ELSE 'normal' END AS threat_type FROM g""")
def r07(spark, sf):
    shares = [F.avg((F.col(c) != al.BENIGN_IDX).cast("double")).alias(c) for c in tb.PREDICTION_COLUMNS.values()]
    g = tb.flows(spark, sf).groupBy("dst_ip").agg(*shares)
    return g.select("dst_ip", sv.threat_type_from_scores([F.col(c) for c in tb.PREDICTION_COLUMNS.values()]).alias("threat_type"))


@query("r08_threat_analysis", f"""WITH {ACT_SQL}, {S.FLOWS}, g AS (SELECT dst_ip, {_SHARES}, {_IND}, min(protocol) AS pr FROM flows GROUP BY 1),
t AS (SELECT dst_ip, CASE WHEN greatest(s0, s1, s2) > 0.8 THEN 'malware' WHEN greatest(s0, s1, s2) > 0.6 THEN 'scan' ELSE 'normal' END AS attack_type,
  {_BSCORE} AS b, {_BLEVEL} AS severity, CASE pr WHEN 6 THEN 0.4e0 WHEN 17 THEN 0.6e0 ELSE 0.8e0 END AS ps FROM g),
r AS (SELECT *, round(CASE severity WHEN 'Low' THEN 0.2e0 WHEN 'Medium' THEN 0.5e0 ELSE 0.8e0 END * 0.4e0
  + CASE attack_type WHEN 'scan' THEN 0.3e0 ELSE 0.5e0 END * 0.25e0 + 0.7e0 * 0.2e0 + ps * 0.15e0, 6) AS score FROM t)
SELECT dst_ip, attack_type, round(b, 6) AS behavior_score, severity, score AS risk_score, {_LEVEL} AS risk_level, im AS immediate, priority,
  'Low' AS operational_impact FROM r JOIN act ON lv = {_LEVEL}""")
def r08(spark, sf):
    out = sv.analyze(tb.flows(spark, sf), ["dst_ip"], tb.PREDICTION_COLUMNS, al.BENIGN_IDX)
    return rounded(out.select("dst_ip", "attack_type", "behavior_score", "severity", "risk_score", "risk_level",
                              F.array_join("immediate", "|").alias("immediate"), "priority", "operational_impact"),
                   "behavior_score", "risk_score")


@query("r09_adjusted_severity", f"""WITH {S.FLOW_ALERTS} SELECT attack_type, CAST(n_agreeing AS INT) AS n_agreeing, severity, count(*) AS n FROM alerts GROUP BY ALL""")
def r09(spark, sf):
    return flow_alerts(spark, sf).groupBy("attack_type", "n_agreeing", "severity").agg(F.count("*").alias("n"))


@query("r10_majority_vote", f"""WITH {S.FLOW_ALERTS} SELECT CAST(threat_votes AS INT) AS threat_votes, ensemble,
  CASE WHEN threat_votes >= 2 THEN 'High' WHEN threat_votes = 1 THEN 'Low' ELSE 'None' END AS run_risk, count(*) AS n FROM alerts GROUP BY ALL""")
def r10(spark, sf):
    return flow_alerts(spark, sf).withColumn("run_risk", al.vote_risk(F.col("threat_votes"))).groupBy(
        "threat_votes", "ensemble", "run_risk").agg(F.count("*").alias("n"))


@query("r11_detecting_models", f"WITH {S.FLOW_ALERTS} SELECT flow_id, attack_type, model_used FROM alerts")
def r11(spark, sf):
    return flow_alerts(spark, sf).select("flow_id", "attack_type", "model_used")


_HEAD = "CASE severity WHEN 'High' THEN '🔥 High risk: ' WHEN 'Medium' THEN '⚠️ Medium risk: ' ELSE '🟡 Low risk: ' END"


def _sentence(n: str) -> str:
    return f"""CASE WHEN {n} >= 2 THEN {_HEAD} || attack_type || ' confirmed by ' || {n} || '/3 models'
    || CASE severity WHEN 'High' THEN ' - immediate action required' WHEN 'Medium' THEN ' - monitor closely' ELSE '' END
  WHEN {n} = 1 THEN {_HEAD} || attack_type || ' detected by 1/3 models'
    || CASE severity WHEN 'High' THEN ' - investigate immediately' WHEN 'Medium' THEN ' - investigate' ELSE '' END
  ELSE {_HEAD} || attack_type || ' detected (ground truth) - ' || CASE severity WHEN 'High' THEN 'manual review required'
    WHEN 'Medium' THEN 'manual review recommended' ELSE 'routine monitoring' END END"""


@query("r12_risk_narrative", f"""WITH {S.FLOW_ALERTS} SELECT CASE WHEN attack_type = 'Benign' THEN '🟢 Low risk: Normal traffic confirmed'
  ELSE {_sentence('n_agreeing')} END AS risk_analysis, count(*) AS n FROM alerts GROUP BY 1""")
def r12(spark, sf):
    return flow_alerts(spark, sf).groupBy("risk_analysis").agg(F.count("*").alias("n"))


@query("r12_batch_narrative", f"""WITH {S.FLOW_ALERTS}, b AS (SELECT attack_type, severity, threat_votes,
  concat_ws(', ', CASE WHEN (attack_type = 'Benign') = (pred_aca_svm = 1) THEN 'ACA_SVM' END, CASE WHEN (attack_type = 'Benign') = (pred_fuzzy_rf = 1) THEN 'Fuzzy_RF' END,
    CASE WHEN (attack_type = 'Benign') = (pred_intrudtree = 1) THEN 'IntruDTree' END) AS names FROM alerts)
SELECT CASE WHEN attack_type = 'Benign' THEN CASE threat_votes WHEN 0 THEN '🟢 Low risk: Normal traffic confirmed by all models'
    WHEN 3 THEN '⚠️ Warning: All models misclassified benign traffic as threat' ELSE '🟢 Low risk: Normal traffic confirmed by ' || (3 - threat_votes) || '/3 models' END
    || CASE WHEN threat_votes < 3 THEN ' | Correctly identified by: ' || names ELSE ' | Misclassified by all models' END
  WHEN threat_votes = 0 THEN CASE WHEN attack_type IN {S.in_list(fv.INHERENT_HIGH)} THEN '⚠️ Medium risk: ' || attack_type || ' detected (ground truth) - manual review recommended'
    ELSE '🟡 Low risk: ' || attack_type || ' detected (ground truth) - routine monitoring' END
  ELSE {_sentence('threat_votes')} || ' | Detected by: ' || names END AS risk_analysis, count(*) AS n FROM b GROUP BY 1""")
def r12_batch(spark, sf):
    a = flow_alerts(spark, sf)
    benign = F.col("attack_type") == fv.BENIGN
    models = F.when(benign, al.agreeing_models(F.lit(al.BENIGN_IDX))).otherwise(al.voting_models())
    text = al.batch_risk_narrative(F.col("attack_type"), F.col("severity"), F.col("threat_votes"), models)
    return a.groupBy(text.alias("risk_analysis")).agg(F.count("*").alias("n"))


@query("r13_prediction_map", f"""WITH {S.LABELS}, {S.FLOWS}, {S.scored('flows')} SELECT model, name AS attack_label, y_pred AS predicted_label, y_pred <> 1 AS predicted_threat,
  (y_pred <> 1) = (y_true <> 1) AS is_correct, count(*) AS n FROM scored JOIN labels9 ON y_pred = idx GROUP BY ALL""")
def r13(spark, sf):
    a = flow_alerts(spark, sf).select(F.explode(al.prediction_map(F.col("true_is_threat"))).alias("model", "p"))
    return a.select("model", "p.*").groupBy("model", "attack_label", "predicted_label", "predicted_threat", "is_correct").agg(
        F.count("*").alias("n"))


@query("r14_model_severity", f"""WITH {S.LABELS}, {S.SCORED} SELECT model, name AS attack_label, CASE WHEN name IN {S.in_list(fv.INHERENT_HIGH)} THEN 'High'
  WHEN name IN {S.in_list(fv.INHERENT_MEDIUM)} THEN 'Medium' ELSE 'Low' END AS model_severity, count(*) AS n FROM scored JOIN labels9 ON y_pred = idx GROUP BY ALL""")
def r14(spark, sf):
    a = flow_alerts(spark, sf).select(F.explode(al.prediction_map(F.col("true_is_threat"))).alias("model", "p"))
    return a.select("model", "p.attack_label", al.model_severity(F.col("p.attack_label"), F.col("p.predicted_threat")).alias("model_severity")).groupBy(
        "model", "attack_label", "model_severity").agg(F.count("*").alias("n"))


# Flow columns the anomaly rules read beyond the flow view.
WIDE = "wide AS (SELECT *, flow_bytes_per_s * 0.4 AS total_fwd_bytes, dst_port % 60 AS bwd_psh_flags, syn_flag_count * 40 AS syn2 FROM alerts)"


def wide_alerts(spark, sf):
    return flow_alerts(spark, sf).withColumns({
        "total_fwd_bytes": F.col("flow_bytes_per_s") * 0.4, "bwd_psh_flags": F.col("dst_port") % 60,
        "syn_flag_count": F.col("syn_flag_count") * 40})


_MIN = "round(flow_duration / 60)"
_DONE = "round(ack_flag_count * 100.0e0 / nullif(syn2, 0))"


@query("r15_anomaly_reasons", f"""WITH {S.FLOW_ALERTS}, {WIDE}, k AS (SELECT concat_ws(',',
  CASE WHEN total_bwd_packets < total_fwd_packets * 0.15 AND total_fwd_packets > 50 THEN 'asymmetry' END,
  CASE WHEN flow_duration > 180 AND {_MIN} >= 60 THEN 'continuous' END,
  CASE WHEN flow_duration > 180 AND {_MIN} > 10 AND {_MIN} < 60 THEN 'persistent' END,
  CASE WHEN syn2 > 10 AND {_DONE} < 30 THEN 'incomplete' END,
  CASE WHEN flow_duration > 5 AND total_fwd_bytes / flow_duration > 50000 THEN 'exfiltration' END,
  CASE WHEN flow_packets_per_s > 150 THEN 'burst' END,
  CASE WHEN bwd_psh_flags > total_fwd_packets * 0.15 AND total_fwd_packets > 30 THEN 'push' END) AS codes,
  CASE WHEN flow_duration > 180 AND {_MIN} >= 60 THEN 'Continuous ' || CAST({_MIN} AS INT) || 'min connection (unusually long)' END AS duration_text FROM wide)
SELECT codes, duration_text, count(*) AS n FROM k GROUP BY ALL""")
def r15(spark, sf):
    w = wide_alerts(spark, sf)
    _, text = al.anomaly_tests(w)["continuous"]
    codes = al.anomaly_codes(w)
    return w.groupBy(F.array_join(codes, ",").alias("codes"), F.when(F.array_contains(codes, "continuous"), text).alias("duration_text")).agg(
        F.count("*").alias("n"))


@query("r15_quiet_flow_fallback", f"""WITH {S.FLOW_ALERTS} SELECT CASE WHEN attack_type = 'Benign' THEN 'Normal balanced traffic'
  WHEN attack_type = 'Hoax' THEN 'False positive - benign pattern' WHEN attack_type IN ('Backdoor', 'Exploit', 'Virus', 'Trojan', 'Worm')
  THEN 'HIGH RISK threat type - Flow Bytes/s pattern detected' WHEN attack_type = 'HackTool' THEN 'Tool usage detected via Flow Bytes/s'
  ELSE 'Flow Bytes/s pattern matching threat signatures' END AS reason, count(*) AS n FROM alerts GROUP BY 1""")
def r15_fallback(spark, sf):
    quiet = flow_alerts(spark, sf).select("attack_type", "flow_bytes_per_s", "total_fwd_packets")
    return quiet.groupBy(F.get(al.anomaly_reasons(quiet.withColumn("total_fwd_packets", F.lit(1)), F.col("attack_type")), F.lit(0)).alias("reason")).agg(
        F.count("*").alias("n"))


def _advice_sql() -> str:
    tests = {"virus_volume": "flow_bytes_per_s > 500000 OR total_fwd_bytes > 1000000", "virus_spread": "total_fwd_packets > 5000",
             "trojan_c2": "bwd_psh_flags > 30 AND flow_duration > 3000", "long_lived": "flow_duration > 1800",
             "worm_spread": "total_fwd_packets > 1000 OR flow_packets_per_s > 200", "syn_heavy": "syn2 > 100",
             "exfiltration": "total_fwd_bytes > 2000000"}
    cases = []
    for word, options in fv.RECOMMENDATIONS.items():
        for test, text in options:
            cond = f"lower(attack_type) LIKE '%{word}%'" + (f" AND ({tests[test]})" if test else "")
            cases.append(f"WHEN {cond} THEN replace(replace({S.q(text)}, '{{dst}}', dst_ip), '{{src}}', src_ip)")
    return "CASE WHEN attack_type = 'Benign' THEN 'Normal traffic - no action required' " + " ".join(cases) + " END"


@query("r16_recommendation", f"""WITH {S.FLOW_ALERTS}, {WIDE} SELECT flow_id, {_advice_sql()} || CASE WHEN attack_type = 'Benign' THEN ''
  WHEN n_agreeing = 3 THEN ' [3/3 high confidence]' WHEN n_agreeing = 2 THEN ' [2/3 models]' ELSE ' [Verify manually]' END AS recommendation FROM wide""")
def r16(spark, sf):
    w = wide_alerts(spark, sf)
    return w.select("flow_id", al.recommendation(w, F.col("attack_type"), F.col("model_used")).alias("recommendation"))


@query("r16_headline", f"""WITH {S.FLOW_ALERTS}, {WIDE} SELECT flow_id, attack_type || ' — detected by ' || greatest(n_agreeing, 1) || '/3 models' || chr(10) || '💡 Recommendation: ' || {_advice_sql()}
  || CASE WHEN attack_type = 'Benign' THEN '' WHEN n_agreeing = 3 THEN ' [3/3 high confidence]' WHEN n_agreeing = 2 THEN ' [2/3 models]' ELSE ' [Verify manually]' END AS headline FROM wide""")
def r16_headline(spark, sf):
    w = wide_alerts(spark, sf)
    return w.select("flow_id", al.headline(w, F.col("attack_type"), F.col("model_used")).alias("headline"))


@query("r17_alert_record", f"""WITH {S.FLOW_ALERTS} SELECT attack_label, severity, ensemble, true_is_threat, CAST(n_agreeing AS INT) AS n_models, count(*) AS n,
  3 AS map_size, round(sum(flow_duration), 3) AS sum_duration, 0.05e0 AS detection_time FROM (SELECT *, attack_type AS attack_label FROM alerts)
GROUP BY ALL""")
def r17(spark, sf):
    r = al.alert_records(tb.flows(spark, sf))
    return r.groupBy("attack_label", "severity", "ensemble", "true_is_threat", F.size("detection_models").alias("n_models"),
                     F.size("model_predictions").alias("map_size"), "detection_time").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("key_features")["Flow Duration"]), 3).alias("sum_duration"))


@query("r18_verification_status", f"""WITH {S.VERIFS}, {S.ALERTS_ENRICHED} SELECT CASE WHEN lower(model_used) IN ('', 'unknown') THEN 'Not detected' WHEN attack_type = 'Benign' THEN 'Not verifiable'
  WHEN is_threat IS NULL THEN 'Needs Review' WHEN is_threat THEN 'Threat Confirmed' ELSE 'False Positive' END AS status, count(*) AS n
FROM alerts a LEFT JOIN active v ON a.flow_id = v.flow_id GROUP BY 1""")
def r18(spark, sf):
    v = vf.active(tb.verifications(spark, sf)).select("flow_id", "is_threat")
    a = al.enrich(tb.alerts(spark, sf)).join(v, "flow_id", "left")
    return a.groupBy(al.verification_status(F.col("is_threat")).alias("status")).agg(F.count("*").alias("n"))


_KFD = [(n, c, fv.FEATURE_DESCRIPTIONS[n]) for n, c in fv.KEY_FEATURES.items() if "packet_length_mean" not in c]


@query("r18_feature_descriptions", f"WITH {S.FLOWS} " + " UNION ALL ".join(
    f"SELECT {S.q(n)} AS feature, {S.q(d)} AS description, count(*) AS n, round(sum({c}), 2) AS total FROM flows" for n, c, d in _KFD))
def r18_features(spark, sf):
    flows = tb.flows(spark, sf)
    e = al.explain_features(flows.select("flow_id", al.key_features(flows).alias("key_features")))
    return e.groupBy("feature", "description").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
