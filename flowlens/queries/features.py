"""Feature engineering, encoding and scaling (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import fixed_values as fv
from flowlens.operators import encode as en, features as ft, scaling as sc
from flowlens.plans import preprocess as pp
from flowlens.queries import query
from flowlens.queries import sql as S
from flowlens.queries.aggregates import rounded
from flowlens.sources import tables as tb

_ST = """s AS (SELECT avg(flow_duration) AS dm, stddev_samp(flow_duration) AS ds, avg(packet_length_mean) AS pm, stddev_samp(packet_length_mean) AS ps,
  max(packet_length_mean) AS px, avg(flow_bytes_per_s) AS bm, stddev_samp(flow_bytes_per_s) AS bs FROM flows)"""


def engineered(spark, sf, *cols):
    return rounded(ft.engineer(tb.flows(spark, sf)).select("flow_id", *cols), *cols)


@query("e01_duration_features", f"""WITH {S.FLOWS}, {_ST} SELECT flow_id, round(ln(1 + abs(flow_duration)), 6) AS flow_duration_log,
  round((flow_duration - dm) / ds, 6) AS flow_duration_std FROM flows, s""")
def e01(spark, sf):
    return engineered(spark, sf, "flow_duration_log", "flow_duration_std")


@query("e02_packet_size_features", f"""WITH {S.FLOWS}, {_ST} SELECT flow_id, round(packet_length_mean / (px + 1e-8), 6) AS packet_size_ratio,
  round((packet_length_mean - pm) / ps, 6) AS packet_size_std FROM flows, s""")
def e02(spark, sf):
    return engineered(spark, sf, "packet_size_ratio", "packet_size_std")


@query("e03_byte_rate_features", f"""WITH {S.FLOWS}, {_ST} SELECT flow_id, round(ln(1 + abs(flow_bytes_per_s)), 6) AS bytes_per_sec_log,
  round((flow_bytes_per_s - bm) / bs, 6) AS bytes_per_sec_std FROM flows, s""")
def e03(spark, sf):
    return engineered(spark, sf, "bytes_per_sec_log", "bytes_per_sec_std")


_SHARE = "least(1, greatest(1e-12, {c} / (t + 1e-8)))"
_ENT = " + ".join(f"{_SHARE.format(c=c)} * log2({_SHARE.format(c=c)})" for c in fv.FLAG_COLUMNS)


@query("e04_flag_features", f"""WITH {S.FLOWS}, f AS (SELECT *, {' + '.join(fv.FLAG_COLUMNS)} AS t FROM flows)
SELECT flow_id, CAST(t AS DOUBLE) AS total_flags, round(-({_ENT}), 6) + 0 AS flag_entropy FROM f""")
def e04(spark, sf):
    return engineered(spark, sf, "total_flags", "flag_entropy")


# One of the three inter-arrival columns is missing on some rows.
_IAT_SQL = "iat AS (SELECT flow_id, flow_iat_mean AS a, fwd_iat_mean AS b, CASE WHEN dst_port % 10 = 0 THEN NULL ELSE bwd_iat_mean END AS c FROM flows)"
_IM = "((a + b + coalesce(c, 0)) / (2 + (c IS NOT NULL)::INT))"
_IS = f"sqrt((power(a - {_IM}, 2) + power(b - {_IM}, 2) + coalesce(power(c - {_IM}, 2), 0)) / (1 + (c IS NOT NULL)::INT))"


@query("e05_iat_features", f"""WITH {S.FLOWS}, {_IAT_SQL} SELECT flow_id, round({_IM}, 7) AS iat_mean, round({_IS}, 6) AS iat_std,
  round({_IS} / ({_IM} + 1e-8), 4) AS iat_ratio FROM iat""")
def e05(spark, sf):
    f = tb.flows(spark, sf).withColumn("bwd_iat_mean", F.expr("case when dst_port % 10 = 0 then null else bwd_iat_mean end"))
    out = ft.engineer(f).select("flow_id", "iat_mean", "iat_std", "iat_ratio")
    return out.withColumns({"iat_mean": F.round("iat_mean", 7), "iat_std": F.round("iat_std", 6), "iat_ratio": F.round("iat_ratio", 4)})


@query("e06_protocol_code", f"""WITH {S.FLOWS} SELECT protocol, (CASE protocol WHEN 1 THEN 0 WHEN 6 THEN 1 ELSE 2 END)::BIGINT AS protocol_encoded, count(*) AS n FROM flows GROUP BY 1, 2""")
def e06(spark, sf):
    f = tb.flows(spark, sf).select("protocol")
    return en.encode_column(f, "protocol", "protocol_encoded").groupBy("protocol", "protocol_encoded").agg(F.count("*").alias("n"))


@query("e07_port_features", f"""WITH {S.FLOWS} SELECT flow_id, abs(src_port - dst_port) AS port_diff, src_port <= 1024 AS is_well_known_src,
  dst_port <= 1024 AS is_well_known_dst FROM flows""")
def e07(spark, sf):
    return ft.engineer(tb.flows(spark, sf)).select("flow_id", "port_diff", "is_well_known_src", "is_well_known_dst")


_CAT = """cat AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS flag,
  md5(CAST(l_suppkey AS VARCHAR)) AS sample, 'p' || l_partkey AS part_name FROM lineitem)"""


@query("e08_categorical_codes", f"""WITH {_CAT}, f AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(flag, '___NA___') AS v FROM cat)),
h AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT sample AS v FROM cat))
SELECT CAST(f.code AS BIGINT) AS flag_encoded, CAST(h.code AS BIGINT) AS sample_encoded, count(*) AS n FROM cat JOIN f ON coalesce(flag, '___NA___') = f.v JOIN h ON sample = h.v GROUP BY 1, 2""")
def e08(spark, sf):
    df = tb.table(spark, sf, "lineitem").selectExpr(
        "case when l_linenumber = 7 then null else l_returnflag end as flag", "md5(cast(l_suppkey as string)) as sample",
        "concat('p', l_partkey) as part_name")
    coded = en.encode_categoricals(df, en.plan_categoricals(df, ["flag", "sample", "part_name"]))
    return coded.groupBy(*coded.columns).agg(F.count("*").alias("n"))


@query("e09_label_index", f"""WITH {S.LABELS}, {S.ALERTS}, x AS (SELECT CASE WHEN event_id % 17 = 0 THEN 'UNKNOWN' ELSE name END AS label FROM alerts0 JOIN labels9 ON label_idx = idx),
d AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i FROM (SELECT DISTINCT label FROM x))
SELECT x.label, CAST(i AS BIGINT) AS label_idx, count(*) AS n FROM x JOIN d ON x.label = d.label GROUP BY 1, 2""")
def e09(spark, sf):
    from flowlens.operators.alerts import class_name

    e = tb.table(spark, sf, "events").select(F.when(F.expr("event_id % 17 <> 0"), class_name(F.expr("event_id % 9"))).alias("label"))
    return en.encode_labels(e).groupBy(F.coalesce("label", F.lit("UNKNOWN")).alias("label"), "label_idx").agg(F.count("*").alias("n"))


_SC = ["flow_duration", "packet_length_mean", "flow_bytes_per_s"]
_NULL_SQL = "nl AS (SELECT flow_id, CASE WHEN dst_port % 10 = 0 THEN NULL ELSE flow_duration END AS flow_duration, packet_length_mean, flow_bytes_per_s FROM flows)"


def with_missing(spark, sf):
    return tb.flows(spark, sf).selectExpr("flow_id", "case when dst_port % 10 = 0 then null else flow_duration end as flow_duration",
                                          "packet_length_mean", "flow_bytes_per_s")


@query("e10_minmax_scaling", f"""WITH {S.FLOWS}, {_NULL_SQL}, s AS (SELECT {', '.join(f'min({c}) AS l{i}, max({c}) AS h{i}' for i, c in enumerate(_SC))} FROM nl)
SELECT flow_id, {', '.join(f'round(({c} - l{i}) / (h{i} - l{i}), 6) AS {c}' for i, c in enumerate(_SC))} FROM nl, s""")
def e10(spark, sf):
    df = with_missing(spark, sf)
    return rounded(sc.scale(df, _SC, sc.lazy_scaler(df, _SC), "minmax"), *_SC)


@query("e10_standard_scaling_imputed", f"""WITH {S.FLOWS}, {_NULL_SQL}, m AS (SELECT median(flow_duration) AS md FROM nl),
s AS (SELECT {', '.join(f'avg({c}) AS l{i}, stddev_pop({c}) AS h{i}' for i, c in enumerate(_SC))} FROM nl)
SELECT flow_id, round((coalesce(flow_duration, md) - l0) / h0, 6) AS flow_duration, {', '.join(f'round(({c} - l{i}) / h{i}, 6) AS {c}' for i, c in enumerate(_SC) if i)} FROM nl, s, m""")
def e10_standard(spark, sf):
    df = with_missing(spark, sf)
    return rounded(sc.scale(df, _SC, sc.fit_scaler(df, _SC, impute=True), "standard", impute=True), *_SC)


TOKENS_SQL = """concat_ws(' ', 'protocol_' || protocol, 'src_port_' || src_port, 'dst_port_' || dst_port,
  CASE WHEN flow_duration < 1 THEN 'short_flow' WHEN flow_duration > 3600 THEN 'long_flow' END,
  CASE WHEN packet_length_mean < 64 THEN 'small_packets' WHEN packet_length_mean > 1400 THEN 'large_packets' END,
  CASE WHEN fin_flag_count > 0 THEN 'flag_fin' END, CASE WHEN syn_flag_count > 0 THEN 'flag_syn' END, CASE WHEN rst_flag_count > 0 THEN 'flag_rst' END,
  CASE WHEN psh_flag_count > 0 THEN 'flag_psh' END, CASE WHEN ack_flag_count > 0 THEN 'flag_ack' END, CASE WHEN urg_flag_count > 0 THEN 'flag_urg' END)"""


@query("e11_flow_tokens", f"WITH {S.FLOWS} SELECT flow_id, {TOKENS_SQL} AS tokens FROM flows")
def e11(spark, sf):
    f = tb.flows(spark, sf)
    return f.select("flow_id", ft.flow_text(f).alias("tokens"))


@query("e12_numbers_text", f"""WITH {S.FLOWS}, {_NULL_SQL} SELECT flow_id, concat_ws(' ', CAST(trunc(flow_duration) AS BIGINT), CAST(trunc(packet_length_mean) AS BIGINT),
  CAST(trunc(flow_bytes_per_s) AS BIGINT)) AS text FROM nl""")
def e12(spark, sf):
    df = with_missing(spark, sf)
    return df.select("flow_id", ft.numbers_text(df, _SC).alias("text"))


# Exact test quota of each class; train classes below a fifth of the largest are drawn up to it when the ratio exceeds 5.
@query("e13_preprocessing", f"""WITH {S.FLOWS}, {S.LABELS}, f AS (SELECT DISTINCT * EXCLUDE (pred_aca_svm, pred_fuzzy_rf, pred_intrudtree) FROM flows),
c AS (SELECT label_idx AS i, count(*) AS n, CAST(floor(count(*) * 0.3e0 + 0.5e0) AS BIGINT) AS test FROM f GROUP BY 1), t AS (SELECT i, n - test AS n FROM c),
m AS (SELECT max(n) AS hi, min(n) AS lo, greatest(floor(max(n) * 0.2), 100) AS target FROM t),
s AS (SELECT 'test' AS split, i, test AS n FROM c UNION ALL SELECT 'train', i, CAST(CASE WHEN hi / lo > 5 AND n < target THEN target ELSE n END AS BIGINT) FROM t, m)
SELECT split, name AS label, dense_rank() OVER (ORDER BY name) - 1 AS label_idx, n, true AS scaled FROM s JOIN labels9 ON idx = i""")
def e13(spark, sf):
    """Whole plan on raw headers, stratified and resampled; rows per (split, class), all features within [0, 1]."""
    from flowlens.operators.alerts import class_name

    raw = tb.flows(spark, sf).drop("pred_aca_svm", "pred_fuzzy_rf", "pred_intrudtree")
    raw = raw.withColumn("Label", class_name(F.col("label_idx"))).drop("label_idx").withColumnsRenamed({
        "src_ip": "Src IP", "dst_ip": "Dst IP", "src_port": "Src Port", "dst_port": "Dst Port", "ts": "Timestamp", "protocol": "Protocol",
        "flow_duration": "Flow Duration", "flow_bytes_per_s": "Flow Bytes/s", "flow_packets_per_s": "Flow Packets/s",
        "packet_length_mean": "Packet Length Mean", "total_fwd_packets": "Total Fwd Packet", "total_bwd_packets": "Total Bwd packets",
        **{c: c.replace("_flag_count", "").upper() + " Flag Count" for c in fv.FLAG_COLUMNS}})
    result = pp.preprocess(raw, pp.PreprocessConfig(fit_on="all"))
    low = F.least(*[F.min(c) for c in result.features])
    high = F.greatest(*[F.max(c) for c in result.features])
    return result.data.groupBy("split", "label", "label_idx").agg(
        F.count("*").alias("n"), ((low >= 0) & (high <= 1 + 1e-9)).alias("scaled"))
