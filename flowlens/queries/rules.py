"""Fuzzy and quantile rule scoring (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import membership as mb
from flowlens.operators import clean as cl, fuzzy as fz
from flowlens.queries import query
from flowlens.queries import sql as S
from flowlens.queries.aggregates import FUZZY_SQL, OVERRIDE, PROBS, fuzzy_flows, probability_rows, rounded
from flowlens.queries.scans import SUMMARY_SQL, packet_summary
from flowlens.sources import tables as tb

_FL = "(fin_flag_count + syn_flag_count + rst_flag_count + psh_flag_count + ack_flag_count + urg_flag_count)"
_IA = "((flow_iat_mean + fwd_iat_mean + bwd_iat_mean) / 3)"
_SIG = [("flow_duration", "d"), ("packet_length_mean", "p"), ("flow_bytes_per_s", "b")]
_PTS = " + ".join(f"CASE WHEN {c} > {a}m + 2 * {a}s THEN 2 WHEN {c} > {a}m + {a}s THEN 1 ELSE 0 END" for c, a in _SIG)


@query("f01_sigma_rules", f"""WITH {S.FLOWS}, s AS (SELECT {', '.join(f'avg({c}) AS {a}m, stddev_samp({c}) AS {a}s' for c, a in _SIG)},
  avg({_FL}) AS fm, stddev_samp({_FL}) AS fs, avg({_IA}) AS im, stddev_samp({_IA}) AS isd FROM flows),
p AS (SELECT flow_id, {_PTS} + CASE WHEN {_FL} > fm + fs THEN 1 ELSE 0 END + CASE WHEN {_IA} < im - isd THEN 1 ELSE 0 END AS fuzzy_points FROM flows, s)
SELECT flow_id, fuzzy_points, round((fuzzy_points - min(fuzzy_points) OVER ()) / (max(fuzzy_points) OVER () - min(fuzzy_points) OVER ()), 6) AS fuzzy_score FROM p""")
def f01(spark, sf):
    return rounded(fz.sigma_score(tb.flows(spark, sf)).select("flow_id", "fuzzy_points", "fuzzy_score"), "fuzzy_score")


@query("f02_quantile_rules", f"""WITH {S.FLOWS}, {SUMMARY_SQL}, q AS (SELECT quantile_cont(packets_per_second, 0.9) AS a, quantile_cont(bytes_per_second, 0.9) AS b,
  quantile_cont(packet_count, 0.8) AS c, quantile_cont(CAST(protocol_encoded AS DOUBLE), 0.95) AS d, quantile_cont(avg_ttl, 0.1) AS e, quantile_cont(avg_ttl, 0.9) AS f FROM summ),
k AS (SELECT flow_id, (CASE WHEN packets_per_second > a THEN 3 ELSE 0 END + CASE WHEN bytes_per_second > b THEN 2 ELSE 0 END + CASE WHEN is_well_known_port = 0 THEN 2 ELSE 0 END
  + CASE WHEN flow_direction = 2 THEN 2 ELSE 0 END + CASE WHEN packet_count > c THEN 1 ELSE 0 END + CASE WHEN protocol_encoded > d THEN 2 ELSE 0 END
  + CASE WHEN avg_ttl < e OR avg_ttl > f THEN 1 ELSE 0 END) / 13 AS s FROM summ, q)
SELECT flow_id, round(s, 6) AS rule_score, CASE WHEN s > 0.5 THEN 1 ELSE 0 END AS rule_label FROM k""")
def f02(spark, sf):
    return rounded(fz.quantile_score(packet_summary(spark, sf)).select("flow_id", "rule_score", "rule_label"), "rule_score")


@query("f02_quantile_rules_padded", f"""WITH {S.FLOWS}, {SUMMARY_SQL}, q AS (SELECT quantile_cont(packets_per_second, 0.9) AS a, quantile_cont(bytes_per_second, 0.9) AS b,
  quantile_cont(packet_count, 0.8) AS c FROM summ)
SELECT rule_label, count(*) AS n FROM (SELECT CASE WHEN (CASE WHEN packets_per_second > a THEN 3 ELSE 0 END + CASE WHEN bytes_per_second > b THEN 2 ELSE 0 END + 2
  + CASE WHEN packet_count > c THEN 1 ELSE 0 END) / 13 > 0.5 THEN 1 ELSE 0 END AS rule_label FROM summ, q) GROUP BY 1""")
def f02_padded(spark, sf):
    p = packet_summary(spark, sf).select("packet_count", "packets_per_second", "bytes_per_second")
    return fz.quantile_score(cl.pad_columns(p)).groupBy("rule_label").agg(F.count("*").alias("n"))


_DIRTY = """CASE WHEN l_linenumber = 7 AND l_partkey % 10 = 0 THEN {inf} WHEN l_linenumber = 7 AND l_partkey % 10 = 1 THEN -{inf}
  WHEN l_linenumber = 7 AND l_partkey % 10 = 2 THEN {nan} WHEN l_linenumber = 7 AND l_partkey % 10 = 3 THEN NULL ELSE CAST(l_extendedprice AS DOUBLE) / {d} END"""
_DIRTY_DUCK = _DIRTY.replace("{inf}", "'inf'::DOUBLE").replace("{nan}", "'nan'::DOUBLE")
_DIRTY_SPARK = _DIRTY.replace("{inf}", "double('Infinity')").replace("{nan}", "double('NaN')")


@query("f02_quantile_rules_dirty", f"""WITH d AS (SELECT l_orderkey, l_linenumber, {_DIRTY_DUCK.format(d=40)} AS p, {_DIRTY_DUCK.format(d=3)} AS b, CAST(l_quantity AS DOUBLE) AS c FROM lineitem),
q AS (SELECT quantile_cont(CASE WHEN isfinite(p) THEN p END, 0.9) AS qp, quantile_cont(CASE WHEN isfinite(b) THEN b END, 0.9) AS qb, quantile_cont(c, 0.8) AS qc FROM d)
SELECT l_orderkey, l_linenumber, round((CASE WHEN p > qp THEN 3 ELSE 0 END + CASE WHEN b > qb THEN 2 ELSE 0 END + CASE WHEN c > qc THEN 1 ELSE 0 END) / 13, 6) AS rule_score FROM d, q""")
def f02_dirty(spark, sf):
    """Rates with NULL, NaN and infinities: quantiles over the finite values, rules on the raw ones."""
    d = tb.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"{_DIRTY_SPARK.format(d=40)} AS packets_per_second", f"{_DIRTY_SPARK.format(d=3)} AS bytes_per_second",
        "double(l_quantity) AS packet_count")
    return rounded(fz.quantile_score(d).select("l_orderkey", "l_linenumber", "rule_score"), "rule_score")


_X, _T = "packet_length_mean", 500


@query("f03_membership", f"""WITH {S.FLOWS} SELECT flow_id, round(CASE WHEN {_X} <= {_T} THEN greatest(0, 1 - {_X} / {_T}) ELSE 0 END, 6) AS low,
  round(CASE WHEN {_X} BETWEEN 0 AND {2 * _T} THEN greatest(0, 1 - abs({_X} - {_T}) / {_T}) ELSE 0 END, 6) AS medium,
  round(CASE WHEN {_X} >= {_T} THEN least(1, ({_X} - {_T}) / {_T}) ELSE 0 END, 6) AS high,
  round(CASE WHEN {_X} >= {2 * _T} THEN least(1, ({_X} - {2 * _T}) / {_T}) ELSE 0 END, 6) AS very_high FROM flows""")
def f03(spark, sf):
    x = F.col(_X)
    fns = {"low": mb.low, "medium": mb.medium, "high": mb.high, "very_high": mb.very_high}
    return tb.flows(spark, sf).select("flow_id", *[F.round(f(x, _T), 6).alias(n) for n, f in fns.items()])


@query("f04_fuzzification", f"""WITH {S.FLOWS} SELECT flow_id, round(CASE WHEN flow_packets_per_s > 1000 THEN least(1, (flow_packets_per_s - 1000) / 1000) ELSE 0 END, 9) AS rate_high,
  round(CASE WHEN flow_packets_per_s BETWEEN 100 AND 1000 THEN (flow_packets_per_s - 100) / 900 ELSE 0 END, 9) AS rate_medium,
  round(CASE WHEN flow_packets_per_s < 100 THEN flow_packets_per_s / 100 ELSE 0 END, 9) AS rate_low,
  round(CASE WHEN flow_duration < 1 THEN least(1, 1 - flow_duration) ELSE 0 END, 9) AS duration_short,
  round(CASE WHEN flow_duration BETWEEN 1 AND 10 THEN (10 - flow_duration) / 9 ELSE 0 END, 9) AS duration_normal,
  round(CASE WHEN {_FL} > 5 THEN least(1, ({_FL} - 5) / 5) ELSE 0 END, 9) AS flags_high,
  round(CASE WHEN packet_length_mean > 0 THEN least(0.6, ln(1 + packet_length_mean) / 10) ELSE 0 END, 9) AS length_medium FROM flows""")
def f04(spark, sf):
    f = fuzzy_flows(spark, sf).withColumn("flow_packets_per_s", F.col("flow_packets_per_s") / 0.5)
    rate = mb.degrees("packets_per_second", F.col("flow_packets_per_s"))
    dur = mb.degrees("flow_duration", F.col("flow_duration"))
    out = {"rate_high": rate["high"], "rate_medium": rate["medium"], "rate_low": rate["low"], "duration_short": dur["short"],
           "duration_normal": dur["normal"], "flags_high": mb.degrees("total_flags", F.col("total_flags"))["high"],
           "length_medium": mb.degrees("packet_length_mean", F.col("packet_length_mean"))["medium"]}
    return f.select("flow_id", *[F.round(c, 9).alias(n) for n, c in out.items()])


_H = ["high_packet_rate", "high_byte_rate", "unusual_port_activity", "short_flow_duration", "large_packet_size", "high_flag_count", "unusual_iat"]


@query("f05_rule_strengths", f"WITH {FUZZY_SQL} SELECT flow_id, {', '.join(f'round(h{i + 1}, 9) AS {n}' for i, n in enumerate(_H))} FROM fs")
def f05(spark, sf):
    f = fuzzy_flows(spark, sf)
    return f.select("flow_id", *[F.round(c, 9).alias(n) for n, c in fz.rule_strengths(f).items()])


@query("f06_fuzzy_score", f"WITH {FUZZY_SQL} SELECT flow_id, round(fuzzy_score, 6) AS fuzzy_score FROM fs")
def f06(spark, sf):
    f = fuzzy_flows(spark, sf)
    return f.select("flow_id", F.round(fz.fuzzy_score(f), 6).alias("fuzzy_score"))


@query("f07_threat_level", f"""WITH {FUZZY_SQL} SELECT CASE WHEN fuzzy_score >= 0.8 THEN 3 WHEN fuzzy_score >= 0.5 THEN 2 WHEN fuzzy_score >= 0.2 THEN 1 ELSE 0 END AS threat_level,
  count(*) AS n FROM fs GROUP BY 1""")
def f07(spark, sf):
    f = fuzzy_flows(spark, sf)
    return f.groupBy(fz.threat_level(fz.fuzzy_score(f)).alias("threat_level")).agg(F.count("*").alias("n"))


_B = {"fuzzy_low": "< 0.3", "fuzzy_medium": "BETWEEN 0.3 AND 0.6999999999", "fuzzy_high": ">= 0.7", "fuzzy_risk_low": "< 0.2",
      "fuzzy_risk_medium": "BETWEEN 0.2 AND 0.5999999999", "fuzzy_risk_high": ">= 0.6", "is_suspicious": "> 0.1", "threat_indicator_weak": "> 0.05",
      "threat_indicator_medium": "> 0.2", "threat_indicator_strong": "> 0.5"}


@query("f08_fuzzy_features", f"""WITH {FUZZY_SQL} SELECT flow_id, round(fuzzy_score, 6) AS fuzzy_score, round(fuzzy_score * 10, 5) AS fuzzy_score_boosted,
  {', '.join(f'CAST(fuzzy_score {t} AS INT) AS {n}' for n, t in _B.items())} FROM fs""")
def f08(spark, sf):
    out = fz.with_fuzzy_features(fuzzy_flows(spark, sf)).select("flow_id", *fz.FUZZY_FEATURES)
    return out.withColumns({"fuzzy_score": F.round("fuzzy_score", 6), "fuzzy_score_boosted": F.round("fuzzy_score_boosted", 5)})


@query("f09_override", f"WITH {S.FLOWS}, {PROBS}, {OVERRIDE} SELECT flow_id, pred, final FROM ov")
def f09(spark, sf):
    rows = probability_rows(spark, sf)
    final = fz.override_prediction(F.col("probs"), F.col("pred"), F.col("fz"))
    return rows.select("flow_id", "pred", final.alias("final"))
