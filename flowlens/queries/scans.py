"""Scans, sinks, projections, filters and joins (S, P and J of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens import fixed_values as fv
from flowlens.functions import numeric as nm, stats as st
from flowlens.operators import (
    alerts as al, balance as bl, clean as cl, compare as cp, encode as en, features as ft, metrics as mt, patterns as pt,
    reports as rp, sampling as sp, scaling as sc, severity as sv, verify as vf,
)
from flowlens.queries import query
from flowlens.queries import sql as S
from flowlens.session import materialize, new_path, small_methods
from flowlens.sources import artifacts as ar, readers, schema as sch, sinks, tables as tb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- scans ------------------------------------------------------------------------
@query("s01_csv_scan", f"""WITH {S.FLOWS}
SELECT label_idx, count(*) AS n, round(sum(flow_duration), 4) AS sum_duration, min(src_ip) AS min_ip,
  max(flow_bytes_per_s) AS max_bytes, sum(dst_port) ::BIGINT AS sum_port FROM flows GROUP BY label_idx""")
def s01(spark, sf):
    schema = T.StructType(list(sch.FLOW_SCHEMA.fields) + [T.StructField("label_idx", T.IntegerType())])
    path = new_path(spark, "flows-csv")
    sinks.write_csv(tb.flows(spark, sf).select(*schema.names), path)
    return readers.read_csv(spark, path, schema).groupBy("label_idx").agg(
        F.count("*").alias("n"), F.round(F.sum("flow_duration"), 4).alias("sum_duration"),
        F.min("src_ip").alias("min_ip"), F.max("flow_bytes_per_s").alias("max_bytes"), F.sum("dst_port").alias("sum_port"))


def _export_value(header: str, k: int) -> str:
    """A feature of the flow view, or a number made from the flow for features that it lacks; valid in both engines."""
    name = sch.feature_column(header)
    if name in sch.FLOW_SCHEMA.names:
        return name
    return f"dst_port + {k}" if name.endswith(sch._WHOLE) else f"dst_port / 4.0 + {k}"


#: Rows of one file of an export: some 200 MB of text, which one task unpacks.
EXPORT_FILE_ROWS = 250_000
_EXPORT = {h: _export_value(h, k) for k, h in enumerate(fv.EXPORT_FEATURES)}


@query("s01_export_scan", f"WITH {S.FLOWS} " + " UNION ALL ".join(
    f"SELECT {S.q(sch.feature_column(h))} AS feature, {S.q(sch.export_schema()[sch.feature_column(h)].dataType.simpleString())} AS kind, "
    f"count({v}) AS n, round(sum(({v})::DOUBLE), 2) AS total FROM flows" for h, v in _EXPORT.items()))
def s01_export(spark, sf):
    """A whole export with its own headers, written and read back by name: every feature typed, none inferred."""
    flows = tb.flows(spark, sf)
    path = new_path(spark, "export")
    out = {"Flow ID": "flow_id", "Src IP": "src_ip", "Src Port": "src_port", "Dst IP": "dst_ip", "Dst Port": "dst_port", "Timestamp": "ts"}
    raw = flows.select(*[F.col(c).alias(h) for h, c in out.items()], *[F.expr(v).alias(h) for h, v in _EXPORT.items()])
    with small_methods(spark):
        sinks.write_csv(raw, path, "gzip", EXPORT_FILE_ROWS)
    back = readers.read_export(spark, path)
    names = [sch.feature_column(h) for h in fv.EXPORT_FEATURES]
    kinds = dict(back.dtypes)
    entries = [F.struct(F.lit(c).alias("feature"), F.lit(kinds[c]).alias("kind"), F.count(c).alias("n"),
                        F.round(F.sum(F.col(c).cast("double")), 2).alias("total")) for c in names]
    with small_methods(spark):  # a row per feature
        return materialize(back.agg(F.array(*entries).alias("e")).select(F.inline("e")), "totals-of-export")


_LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
             "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("s02_schema_probe", " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{c}' AS column_name, count({c}) AS non_null FROM lineitem" for i, c in enumerate(_LINEITEM)))
def s02(spark, sf):
    df = tb.table(spark, sf, "lineitem")
    one = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), F.col(c).alias("non_null"))
        for i, c in enumerate(df.columns)])))


@query("s03_row_count", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def s03(spark, sf):
    return union_all([tb.table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
                      for t in TABLES])


@query("s04_exact_sample", f"""WITH {S.ALERTS}
SELECT flow_id, label_idx, detection_time FROM alerts0 ORDER BY md5(flow_id || '#42') LIMIT 1000""")
def s04(spark, sf):
    return sp.sample_exact(tb.alerts(spark, sf), "flow_id", 1000).select("flow_id", "label_idx", "detection_time")


@query("s05_random_downsample", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5(o_orderkey || '#7') LIMIT 2500")
def s05(spark, sf):
    orders = tb.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sp.sample_exact(orders, "o_orderkey", 2500, seed=7)


@query("s06_stratified_downsample", """WITH r AS (SELECT o_orderkey, o_orderpriority,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '#42')) AS rn,
  count(*) OVER (PARTITION BY o_orderpriority) AS sz, count(*) OVER () AS total FROM orders)
SELECT o_orderkey, o_orderpriority FROM r WHERE rn <= greatest(1, floor(3000 * sz / total + 0.5))""")
def s06(spark, sf):
    orders = tb.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return sp.sample_stratified(orders, "o_orderkey", "o_orderpriority", 3000)


@query("s07_reservoir_sample", "SELECT event_id, event_type FROM events ORDER BY md5(event_id || '#42') LIMIT 500")
def s07(spark, sf):
    return sp.bottom_k(tb.table(spark, sf, "events").select("event_id", "event_type"), "event_id", 500)


@query("s08_signature_file", """SELECT n_name AS pattern, r_name AS category
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def s08(spark, sf):
    """A signature file made of the nations, with one comment line per region."""
    nation, region = tb.table(spark, sf, "nation"), tb.table(spark, sf, "region")
    groups = nation.join(region, nation.n_regionkey == region.r_regionkey).groupBy("r_name").agg(
        F.array_join(F.sort_array(F.collect_list("n_name")), "\n").alias("names"))
    path = new_path(spark, "signatures")
    groups.select(F.concat(F.lit("# "), "r_name", F.lit("\n\n"), "names", F.lit("\n")).alias("value")).write.text(path)
    return readers.read_signatures(spark, path)


def _signature_sql(source: str, text: str) -> str:
    names = list(dict.fromkeys(fv.MALWARE_SIGNATURES + fv.THREAT_PATTERNS))
    return f"""WITH {S.values('p', ['pattern'], [(n,) for n in names])},
h AS (SELECT pattern, (length({text}) - length(replace({text}, pattern, ''))) // length(pattern) AS n FROM {source}, p)
SELECT pattern, CAST(sum(n) AS BIGINT) AS total_matches, count(*) FILTER (n > 0) AS texts_hit,
  round(CASE WHEN sum(sum(n)) OVER () > 0 THEN sum(n) / sum(sum(n)) OVER () ELSE 0 END, 6) AS share FROM h GROUP BY pattern"""


@query("s09_builtin_signatures", _signature_sql("pages", "html"))
def s09(spark, sf):
    names = list(dict.fromkeys(fv.MALWARE_SIGNATURES + fv.THREAT_PATTERNS))
    return pt.pattern_statistics(tb.table(spark, sf, "pages"), "html", names).withColumn("share", F.round("share", 6))


_SPLIT_SQL = "CASE WHEN ('0x' || substr(md5(flow_id || '#42'), 1, 8))::BIGINT / 4294967296.0e0 < 0.3 THEN 'test' ELSE 'train' END"


@query("s10_processed_sink", f"""WITH {S.FLOWS}
SELECT {_SPLIT_SQL} AS split, label_idx, count(*) AS n FROM flows GROUP BY 1, 2""")
def s10(spark, sf):
    path = new_path(spark, "processed")
    sinks.write_processed(sp.split_hash(tb.flows(spark, sf), "flow_id"), path)
    return sinks.read_processed(spark, path).groupBy("split", "label_idx").agg(F.count("*").alias("n"))


@query("s11_preprocessing_info", f"""WITH {S.FLOWS}, c AS (SELECT label_idx, count(*) AS n FROM flows GROUP BY 1)
SELECT label_idx, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight, 2 AS feature_count, 9 AS n_classes,
  'minmax' AS scaler_type FROM c""")
def s11(spark, sf):
    flows = tb.flows(spark, sf)
    path = new_path(spark, "info")
    info = sinks.preprocessing_info(flows, ["flow_duration", "flow_bytes_per_s"], fv.CLASSES,
                                    bl.class_weights(flows, "label_idx"), "minmax")
    sinks.write_json(info, path)
    back = spark.read.schema("feature_count int, label_classes array<string>, scaler_type string, "
                             "class_weights map<string,double>").json(path)
    return back.select("feature_count", F.size("label_classes").alias("n_classes"), "scaler_type",
                       F.explode("class_weights").alias("label_idx", "weight")).withColumns({
        "label_idx": F.col("label_idx").cast("int"), "weight": F.round("weight", 6)})


@query("s12_processed_read", f"""WITH {S.FLOWS}
SELECT flow_id, flow_duration, label_idx FROM flows WHERE {_SPLIT_SQL} = 'test'""")
def s12(spark, sf):
    path = new_path(spark, "processed")
    sinks.write_processed(sp.split_hash(tb.flows(spark, sf).select("flow_id", "flow_duration", "label_idx"), "flow_id"), path)
    return sinks.read_processed(spark, path, "test").select("flow_id", "flow_duration", "label_idx")


@query("s13_fitted_state", f"WITH {S.FLOWS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, min({c}) AS lo, max({c}) AS hi, round(avg({c}), 4) AS mean FROM flows"
    for c in ("flow_duration", "packet_length_mean", "flow_bytes_per_s")))
def s13(spark, sf):
    cols = ["flow_duration", "packet_length_mean", "flow_bytes_per_s"]
    path = new_path(spark, "stats")
    ar.save_stats(spark, sc.fit_scaler(tb.flows(spark, sf), cols), path)
    s = ar.load_stats(spark, path)
    return spark.createDataFrame(
        [(c, s[f"{c}__min"], s[f"{c}__max"], round(s[f"{c}__mean"], 4)) for c in cols],
        "feature string, lo double, hi double, mean double")


MODEL_TYPES = {"ACA_SVM": "LinearSVC", "Fuzzy_RF": "RandomForest", "IntruDTree": "DecisionTree"}

QUALITY_SQL = f"""{S.SCORED},
conf AS (SELECT model, y_true, y_pred, count(*) AS n FROM scored GROUP BY ALL),
cls AS (SELECT DISTINCT model, y_true AS c FROM conf UNION SELECT DISTINCT model, y_pred FROM conf),
pc AS (SELECT k.model, k.c, coalesce(sum(n) FILTER (y_true = c AND y_pred = c), 0) AS tp,
  coalesce(sum(n) FILTER (y_pred = c), 0) AS pred, coalesce(sum(n) FILTER (y_true = c), 0) AS supp
  FROM cls k JOIN conf f ON k.model = f.model GROUP BY 1, 2),
pm AS (SELECT model, c, supp, CASE WHEN pred > 0 THEN tp / pred ELSE 0 END AS precision,
  CASE WHEN supp > 0 THEN tp / supp ELSE 0 END AS recall,
  CASE WHEN pred + supp > 0 THEN 2 * tp / (pred + supp) ELSE 0 END AS f1_score FROM pc),
quality AS (SELECT model, 100 * (SELECT sum(n) FILTER (y_true = y_pred) / sum(n) FROM conf f WHERE f.model = pm.model) AS accuracy,
  100 * sum(precision * supp) / sum(supp) AS precision, 100 * sum(recall * supp) / sum(supp) AS recall,
  100 * sum(f1_score * supp) / sum(supp) AS f1_score FROM pm GROUP BY model),
long AS (SELECT model, 'accuracy' AS metric, accuracy AS value FROM quality UNION ALL SELECT model, 'precision', precision FROM quality
  UNION ALL SELECT model, 'recall', recall FROM quality UNION ALL SELECT model, 'f1_score', f1_score FROM quality),
ranked AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY round(value, 9) DESC, model) AS rank FROM long),
overall AS (SELECT model, avg(rank) AS mean_rank, row_number() OVER (ORDER BY avg(rank), model) AS overall_rank FROM ranked GROUP BY model),
bin AS (SELECT model, count(*) FILTER (y_true <> 1 AND y_pred <> 1) AS tp, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tn,
  count(*) FILTER (y_true = 1 AND y_pred <> 1) AS fp, count(*) FILTER (y_true <> 1 AND y_pred = 1) AS fn, count(*) AS n
  FROM scored GROUP BY model)"""


@query("s14_comparison_export", f"""WITH {QUALITY_SQL}
SELECT 'performance' AS section, model, metric AS item, round(value, 6) AS value FROM long
UNION ALL SELECT 'ranking', model, 'overall_rank', overall_rank FROM overall
UNION ALL SELECT 'technical', model, 'threats_detected', tp + fp FROM bin
UNION ALL SELECT 'technical', model, 'actual_threats', tp + fn FROM bin
UNION ALL SELECT 'technical', model, 'training_samples', n FROM bin""")
def s14(spark, sf):
    conf = mt.confusion(tb.flows(spark, sf))
    long = cp.long_metrics(mt.quality(conf))
    parts = []
    for name, df in cp.export_sections(long, mt.binary_counts(conf), MODEL_TYPES, 20).items():
        path = new_path(spark, f"export-{name}")
        sinks.write_csv(df, path)
        back = readers.read_csv(spark, path, df.schema)
        items = [c for c in df.columns if c not in ("model", "model_type", "feature_count")]
        parts.append(back.select("model", *[F.col(c).cast("double").alias(c) for c in items]).unpivot(
            ["model"], items, "item", "value").select(
            F.lit(name).alias("section"), "model", "item", F.round("value", 6).alias("value")))
    return union_all(parts)


_REPORT_ACTIONS = S.values("act", ["severity", "action", "description", "timeframe"],
                           [(s, *t) for s, t in fv.REPORT_ACTIONS.items()])
RISK_SQL = f"""{_REPORT_ACTIONS}, {S.ALERTS_ENRICHED},
rc AS (SELECT severity, attack_type, count(*) AS n FROM alerts WHERE {S.VALID} GROUP BY 1, 2),
rt AS (SELECT severity, sum(n) AS n FROM rc GROUP BY 1),
tops AS (SELECT severity, string_agg(attack_type || ' (' || n || ')', '; ' ORDER BY n DESC, attack_type) AS top_attacks
  FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY n DESC, attack_type) AS r FROM rc) WHERE r <= 3 GROUP BY 1),
risk AS (SELECT a.severity, CAST(coalesce(rt.n, 0) AS BIGINT) AS n,
  coalesce(rt.n, 0) * 100.0e0 / (SELECT sum(n) FROM rc) AS percentage, coalesce(top_attacks, '') AS top_attacks,
  action, description, timeframe FROM act a LEFT JOIN rt USING (severity) LEFT JOIN tops USING (severity))"""

_FREQ_BODY = f"""freq0 AS (SELECT attack_type, count(*) AS n, count(*) FILTER (severity = 'High') AS high,
  count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low
  FROM alerts WHERE {S.VALID} AND lower(attack_type) <> 'benign' GROUP BY 1),
freq AS (SELECT *, n * 100.0e0 / sum(n) OVER () AS percentage FROM freq0)"""
FREQ_SQL = f"{S.ALERTS_ENRICHED},\n{_FREQ_BODY}"


def _report_back(spark, df: DataFrame, label: str) -> DataFrame:
    path = new_path(spark, label)
    sinks.write_csv(df, path)
    back = spark.read.option("header", True).schema(df.schema).csv(path)
    return back.select(*[F.col(f"`{c}`").alias(sch.canonical_name(c)) for c in back.columns])


@query("s15_risk_csv", f"""WITH {RISK_SQL}
SELECT severity AS severity_level, n AS count, round(percentage, 2) || '%' AS percentage,
  nullif(top_attacks, '') AS top_attack_types, action AS recommended_action FROM risk""")
def s15(spark, sf):
    report = rp.risk_report(al.enrich(tb.alerts(spark, sf)))
    return _report_back(spark, rp.risk_export(report), "risk-csv")


@query("s16_frequency_csv", f"""WITH {FREQ_SQL}
SELECT attack_type, n AS count, round(percentage, 2) || '%' AS percentage, high AS high_severity,
  medium AS medium_severity, low AS low_severity FROM freq""")
def s16(spark, sf):
    freq = rp.attack_frequency(al.enrich(tb.alerts(spark, sf)))
    return _report_back(spark, rp.frequency_export(freq), "frequency-csv")


@query("s18_detection_log", f"""WITH {S.FLOWS}, l AS (
  SELECT 'ACA_SVM' AS model_name, flow_id, pred_aca_svm AS prediction, flow_iat_mean / 10 AS c, flow_duration AS d FROM flows
  UNION ALL SELECT 'Fuzzy_RF', flow_id, pred_fuzzy_rf, fwd_iat_mean / 10, flow_duration FROM flows)
SELECT model_name, prediction, count(*) AS n, round(avg(c), 6) AS mean_confidence, round(sum(d), 3) AS sum_duration,
  'pending' AS verification_status FROM l GROUP BY 1, 2""")
def s18(spark, sf):
    flows = tb.flows(spark, sf).withColumn("c1", F.col("flow_iat_mean") / 10).withColumn("c2", F.col("fwd_iat_mean") / 10)
    path = new_path(spark, "detections")
    sinks.append_detections(sinks.detection_log(flows, "ACA_SVM", "pred_aca_svm", "c1", ["flow_duration"]), path)
    sinks.append_detections(sinks.detection_log(flows, "Fuzzy_RF", "pred_fuzzy_rf", "c2", ["flow_duration"]), path)
    return readers.read_detection_log(spark, path).groupBy("model_name", "prediction", "verification_status").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.round(F.sum(F.col("features")["flow_duration"]), 3).alias("sum_duration"))


@query("s19_tolerant_json", """WITH t AS (SELECT CASE WHEN event_id % 10 = 0 THEN NULL
  ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) END AS k FROM events)
SELECT k, count(*) AS n, count(*) FILTER (k IS NULL) AS bad FROM t GROUP BY k""")
def s19(spark, sf):
    path = new_path(spark, "jsonl")
    tb.table(spark, sf, "events").select(
        F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken "), "props")).otherwise(F.col("props")).alias("value")
    ).write.text(path)
    lines = readers.read_json_lines(spark, path, T.StructType([T.StructField("k", T.IntegerType())]))
    return lines.groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col(readers.CORRUPT).isNotNull()).alias("bad"))


@query("s22_label_discovery", "SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1")
def s22(spark, sf):
    df = tb.table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "Attack_Type")
    return sch.with_label(df).groupBy("label").agg(F.count("*").alias("n"))


@query("s23_ip_alias", """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN '10.0.0.' || (user_id % 256)
  WHEN event_id % 7 <> 0 THEN '10.9.9.' || (event_id % 99) ELSE 'N/A' END AS src_ip,
  CASE WHEN event_id % 4 = 0 THEN 'N/A' ELSE '192.168.1.' || (event_id % 50) END AS dst_ip FROM events""")
def s23(spark, sf):
    raw = tb.table(spark, sf, "events").selectExpr(
        "event_id", "case when event_id % 5 = 0 then '  ' else concat('10.0.0.', user_id % 256) end as `Source IP`",
        "case when event_id % 7 = 0 then null else concat('10.9.9.', event_id % 99) end as srcip",
        "case when event_id % 4 = 0 then '' else concat(' 192.168.1.', event_id % 50) end as `Destination IP`")
    return sch.with_ips(raw).select("event_id", "src_ip", "dst_ip")


_N_COLUMNS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
              "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


@query("s24_shape_report", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {n} AS n_columns, count(*) AS n_rows FROM {t}" for t, n in _N_COLUMNS.items()))
def s24(spark, sf):
    parts = []
    for t in TABLES:
        df = tb.table(spark, sf, t)
        parts.append(df.agg(F.count("*").alias("n_rows")).select(
            F.lit(t).alias("table_name"), F.lit(len(df.columns)).alias("n_columns"), "n_rows"))
    return union_all(parts)


# --- projections and filters -------------------------------------------------------
DIRTY = """dirty AS (SELECT flow_id, label_idx, flow_duration,
  CASE WHEN src_port % 7 = 0 AND dst_port % 10 = 0 THEN NULL WHEN src_port % 7 = 0 AND dst_port % 10 = 1 THEN CAST('NaN' AS DOUBLE)
    WHEN src_port % 7 = 0 AND dst_port % 10 = 2 THEN CAST('Infinity' AS DOUBLE)
    WHEN src_port % 7 = 0 AND dst_port % 10 = 3 THEN CAST('-Infinity' AS DOUBLE) ELSE flow_bytes_per_s END AS flow_bytes_per_s,
  CASE WHEN dst_port % 10 = 4 THEN 'abc' WHEN dst_port % 10 = 5 THEN NULL ELSE CAST(src_port AS VARCHAR) END AS text_number
  FROM flows)"""


def dirty(spark, sf) -> DataFrame:
    return tb.flows(spark, sf).selectExpr(
        "flow_id", "label_idx", "flow_duration",
        "case when src_port % 7 = 0 and dst_port % 10 = 0 then null when src_port % 7 = 0 and dst_port % 10 = 1 then double('NaN') "
        "when src_port % 7 = 0 and dst_port % 10 = 2 then double('Infinity') "
        "when src_port % 7 = 0 and dst_port % 10 = 3 then double('-Infinity') else flow_bytes_per_s end as flow_bytes_per_s",
        "case when dst_port % 10 = 4 then 'abc' when dst_port % 10 = 5 then null else cast(src_port as string) end as text_number")


FINITE = "CASE WHEN isnan({c}) OR isinf({c}) THEN NULL ELSE {c} END"


@query("p01_nullify_non_finite", f"""WITH {S.FLOWS}, {DIRTY}
SELECT flow_id, {FINITE.format(c='flow_bytes_per_s')} AS flow_bytes_per_s FROM dirty""")
def p01(spark, sf):
    return cl.nullify_non_finite(dirty(spark, sf)).select("flow_id", "flow_bytes_per_s")


@query("p02_drop_empty_rows", f"""WITH {S.FLOWS}, e AS (SELECT CASE WHEN dst_port % 10 < 3 THEN NULL ELSE flow_duration END AS a,
  CASE WHEN dst_port % 10 < 2 THEN NULL ELSE label_idx END AS b FROM flows)
SELECT b AS label_idx, count(*) AS n, count(a) AS with_duration FROM e WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY 1""")
def p02(spark, sf):
    df = tb.flows(spark, sf).selectExpr("case when dst_port % 10 < 3 then null else flow_duration end as a",
                                        "case when dst_port % 10 < 2 then null else label_idx end as label_idx")
    return cl.drop_empty_rows(df).groupBy("label_idx").agg(F.count("*").alias("n"), F.count("a").alias("with_duration"))


@query("p03_split_metadata", f"""WITH {S.FLOWS}
SELECT 'metadata' AS part, 6 AS n_columns, count(*) AS n, sum(src_port) ::BIGINT AS checksum FROM flows
UNION ALL SELECT 'features', 21, count(*), sum(total_fwd_packets) ::BIGINT FROM flows""")
def p03(spark, sf):
    meta, feats = cl.split_metadata(tb.flows(spark, sf))
    row = lambda d, name, c: d.agg(F.count("*").alias("n"), F.sum(c).alias("checksum")).select(
        F.lit(name).alias("part"), F.lit(len(d.columns)).alias("n_columns"), "n", "checksum")
    return row(meta, "metadata", "src_port").unionByName(row(feats, "features", "total_fwd_packets"))


_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("p04_numeric_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean FROM lineitem" for c in _NUMERIC))
def p04(spark, sf):
    df = tb.table(spark, sf, "lineitem")
    cols = sch.numeric_columns(df)
    return df.agg(*[F.round(F.avg(c), 6).alias(c) for c in cols]).unpivot([], cols, "column_name", "mean")


@query("p05_coerce_and_fill", f"""WITH {S.FLOWS}, {DIRTY}
SELECT label_idx, round(flow_duration, 6) AS flow_duration, coalesce({FINITE.format(c='flow_bytes_per_s')}, 0) AS flow_bytes_per_s,
  coalesce(try_cast(text_number AS DOUBLE), 0) AS text_number FROM dirty""")
def p05(spark, sf):
    return cl.final_cleanup(dirty(spark, sf), coerce=("text_number",))


@query("p06_valid_alerts", f"""WITH {S.ALERTS_ENRICHED}
SELECT attack_type, model_used, count(*) AS n FROM alerts WHERE {S.VALID} GROUP BY 1, 2""")
def p06(spark, sf):
    return al.enrich(tb.alerts(spark, sf)).filter(al.is_valid_alert()).groupBy("attack_type", "model_used").agg(
        F.count("*").alias("n"))


@query("p07_faceted_filter", f"""WITH {S.VERIFS}, {S.ALERTS_ENRICHED}
SELECT flow_id, attack_type, severity FROM alerts WHERE {S.VALID} AND attack_type IN ('Trojan', 'Worm', 'Hoax')
  AND lower(severity) = 'high' AND (model_used LIKE '%Fuzzy_RF%' OR model_used LIKE '%IntruDTree%')
  AND flow_id NOT IN (SELECT flow_id FROM active)""")
def p07(spark, sf):
    return al.filter_alerts(
        al.enrich(tb.alerts(spark, sf)), attack_types=["Trojan", "Worm", "Hoax"], severity="HIGH",
        models=[fv.MODEL_DISPLAY_NAMES["fuzzy_rf"], fv.MODEL_DISPLAY_NAMES["intrudtree"]],
        verification="unverified", verified=vf.active(tb.verifications(spark, sf))).select("flow_id", "attack_type", "severity")


def newest(alerts: DataFrame):
    """Newest alert time as a scalar: the report's reference time."""
    return st.lazy(alerts, ts=F.max("ts"))["ts"]


@query("p08_recent_alerts", f"""WITH {S.ALERTS}
SELECT flow_id, label_idx FROM alerts0 WHERE ts >= (SELECT max(ts) FROM alerts0) - INTERVAL 30 MINUTES""")
def p08(spark, sf):
    a = tb.alerts(spark, sf)
    text = a.withColumn("text_ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return text.filter(al.recent(al.parse_iso(F.col("text_ts")), newest(a))).select("flow_id", "label_idx")


@query("p09_exclude_benign", f"""WITH {S.ALERTS_ENRICHED}
SELECT attack_type, count(*) AS n FROM alerts WHERE lower(attack_type) <> 'benign' GROUP BY 1""")
def p09(spark, sf):
    return al.enrich(tb.alerts(spark, sf)).filter(~al.is_benign()).groupBy("attack_type").agg(F.count("*").alias("n"))


@query("p10_valid_analysis_time", f"""WITH {S.VERIFS}
SELECT flow_id, analysis_time FROM verifs WHERE analysis_time BETWEEN 2 AND 300""")
def p10(spark, sf):
    t = vf.valid_analysis_time(F.col("analysis_time").cast("string"))
    return tb.verifications(spark, sf).select("flow_id", t.alias("analysis_time")).filter("analysis_time is not null")


_KF = [(n, c) for n, c in fv.KEY_FEATURES.items() if c not in ("fwd_packet_length_mean", "bwd_packet_length_mean")]


@query("p11_key_features", f"WITH {S.FLOWS} " + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, count(*) AS n, round(sum({c}), 2) AS total FROM flows" for n, c in _KF))
def p11(spark, sf):
    flows = tb.flows(spark, sf)
    return flows.select(F.explode(al.key_features(flows)).alias("feature", "value")).groupBy("feature").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("p11_text_features", f"""WITH {S.FLOWS}
SELECT feature, count(*) AS n, count(DISTINCT value) AS values_ FROM (
  SELECT 'src_ip' AS feature, src_ip AS value FROM flows UNION ALL SELECT 'dst_ip', dst_ip FROM flows UNION ALL SELECT 'flow_id', flow_id FROM flows) GROUP BY 1""")
def p11_text(spark, sf):
    """Where few of the analyst's features exist, text columns top them up as text."""
    slim = tb.flows(spark, sf).select("flow_duration", "src_ip", "dst_ip", "flow_id", "dst_port")
    return slim.select(F.explode(al.key_feature_texts(slim)).alias("feature", "value")).groupBy("feature").agg(
        F.count("*").alias("n"), F.count_distinct("value").alias("values_"))


_TEXT_COLS = ["protocol", "flow_id", "flow_duration", "packet_length_mean", "flow_bytes_per_s", "flow_packets_per_s"]


@query("p12_text_columns", f"""WITH {S.FLOWS}
SELECT flow_id, concat_ws(' ', protocol, CAST(trunc(flow_duration) AS BIGINT), CAST(trunc(packet_length_mean) AS BIGINT),
  CAST(trunc(flow_bytes_per_s) AS BIGINT), total_fwd_packets, syn_flag_count, CAST(trunc(flow_iat_mean) AS BIGINT), src_port) AS text FROM flows""")
def p12(spark, sf):
    flows = tb.flows(spark, sf).select("flow_id", "src_port", "protocol", "flow_duration", "packet_length_mean",
                                       "flow_bytes_per_s", "total_fwd_packets", "syn_flag_count", "flow_iat_mean")
    chosen = [c for c in ft.text_columns(flows) if c != "flow_id"]
    return flows.select("flow_id", ft.numbers_text(flows, chosen).alias("text"))


_VAR = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice"]


@query("p13_low_variance", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(var_pop({c}), {3 if c == 'l_extendedprice' else 6}) AS variance, var_pop({c}) > 0.01 AS kept FROM lineitem"
    for c in _VAR))
def p13(spark, sf):
    v = cl.low_variance_features(tb.table(spark, sf, "lineitem"), _VAR)
    return v.withColumn("variance", F.when(F.col("feature") == "l_extendedprice", F.round("variance", 3)).otherwise(
        F.round("variance", 6)))


SUMMARY_SQL = """summ AS (SELECT flow_id, CAST(total_fwd_packets AS DOUBLE) AS packet_count, flow_duration AS duration,
  flow_packets_per_s AS packets_per_second, flow_bytes_per_s AS bytes_per_second, CAST(dst_port <= 1024 AS INT) AS is_well_known_port,
  protocol AS protocol_encoded, dst_port % 3 AS flow_direction, CAST(src_port % 255 AS DOUBLE) AS avg_ttl FROM flows)"""


def packet_summary(spark, sf) -> DataFrame:
    """Packet-summary columns over the flow view."""
    return tb.flows(spark, sf).selectExpr(
        "flow_id", "cast(total_fwd_packets as double) as packet_count", "flow_duration as duration",
        "flow_packets_per_s as packets_per_second", "flow_bytes_per_s as bytes_per_second",
        "cast(dst_port <= 1024 as int) as is_well_known_port", "protocol as protocol_encoded",
        "dst_port % 3 as flow_direction", "cast(src_port % 255 as double) as avg_ttl")


_SUMMARY_PRESENT = {"packet_count", "duration", "packets_per_second", "bytes_per_second", "is_well_known_port",
                    "protocol_encoded", "flow_direction", "avg_ttl"}


@query("p14_pad_columns", f"WITH {S.FLOWS}, {SUMMARY_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(CAST(sum({c if c in _SUMMARY_PRESENT else '0'}) AS DOUBLE), 2) AS total FROM summ"
    for c in fv.PACKET_SUMMARY_COLUMNS))
def p14(spark, sf):
    padded = cl.pad_columns(packet_summary(spark, sf))
    return padded.agg(*[F.round(F.sum(c), 2).alias(c) for c in padded.columns]).unpivot([], padded.columns, "column_name", "total")


# --- joins ------------------------------------------------------------------------------
@query("j01_derived_columns", f"""WITH {S.FLOWS}
SELECT flow_id, flow_duration, fin_flag_count + syn_flag_count + rst_flag_count + psh_flag_count + ack_flag_count + urg_flag_count AS total_flags
FROM flows""")
def j01(spark, sf):
    total = nm.row_sum([F.col(c) for c in fv.FLAG_COLUMNS]).cast("int")
    return tb.flows(spark, sf).withColumns({"total_flags": total}).select("flow_id", "flow_duration", "total_flags")


@query("j02_alerts_with_verdicts", f"""WITH {S.VERIFS}, {S.ALERTS_ENRICHED}
SELECT a.flow_id, attack_type, is_threat FROM alerts a JOIN active v ON a.flow_id = v.flow_id""")
def j02(spark, sf):
    return vf.verified_alerts(al.enrich(tb.alerts(spark, sf)), tb.verifications(spark, sf)).select(
        "flow_id", "attack_type", "is_threat")


@query("j03_verified_semi_anti", f"""WITH {S.VERIFS}, {S.ALERTS}
SELECT CASE WHEN flow_id IN (SELECT flow_id FROM active) THEN 'verified' ELSE 'unverified' END AS side, count(*) AS n
FROM alerts0 GROUP BY 1""")
def j03(spark, sf):
    a, v = tb.alerts(spark, sf).select("flow_id"), vf.active(tb.verifications(spark, sf)).select("flow_id")
    count = lambda how, name: a.join(v, "flow_id", how).agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return count("left_semi", "verified").unionByName(count("left_anti", "unverified"))


@query("j04_label_lookup", f"""WITH {S.LABELS}, {S.ALERTS}, x AS (
  SELECT CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN label_idx + 9 ELSE label_idx END AS i FROM alerts0)
SELECT coalesce(name, CASE WHEN i IS NULL THEN 'Unknown' ELSE 'Attack_' || i END) AS attack_label, count(*) AS n
FROM x LEFT JOIN labels9 ON i = idx GROUP BY 1""")
def j04(spark, sf):
    e = tb.table(spark, sf, "events").selectExpr(
        "cast(case when event_id % 13 = 0 then null when event_id % 11 = 0 then event_id % 9 + 9 else event_id % 9 end as int) as i")
    return en.with_label_name(e, "i", "attack_label").groupBy("attack_label").agg(F.count("*").alias("n"))


_SEV = S.values("sev", ["t", "s"], list(fv.THREAT_SEVERITY.items()))


@query("j05_severity_lookup", f"""WITH {_SEV}, {S.ALERTS_ENRICHED}
SELECT attack_type AS threat_type, coalesce(s, 'Medium') AS base_severity, count(*) AS n
FROM alerts LEFT JOIN sev ON lower(attack_type) = t GROUP BY 1, 2""")
def j05(spark, sf):
    a = al.enrich(tb.alerts(spark, sf)).select(F.col("attack_type").alias("threat_type"))
    table = sv.severity_table(spark).withColumnRenamed("threat_type", "key")
    return a.join(F.broadcast(table), F.lower("threat_type") == F.col("key"), "left").withColumn(
        "base_severity", F.coalesce("base_severity", F.lit(fv.THREAT_SEVERITY_DEFAULT))).groupBy(
        "threat_type", "base_severity").agg(F.count("*").alias("n"))


_IMPACT = S.values("imp", ["k", "a", "b", "c", "d"], [(k, *v) for k, v in fv.IMPACT_LEVELS.items()])


@query("j06_impact_lookup", f"""WITH {_IMPACT}, {S.ALERTS_ENRICHED}
SELECT attack_type, coalesce(a, 'Low') AS operational_impact, coalesce(b, 'Low') AS data_impact,
  coalesce(c, 'Low') AS financial_impact, coalesce(d, 'Low') AS reputation_impact, count(*) AS n
FROM alerts LEFT JOIN imp ON lower(attack_type) = k GROUP BY ALL""")
def j06(spark, sf):
    dims = [f"{d}_impact" for d in fv.IMPACT_DIMENSIONS]
    return sv.with_impact(al.enrich(tb.alerts(spark, sf)), "attack_type").groupBy("attack_type", *dims).agg(
        F.count("*").alias("n"))


ACT_SQL = S.values("act", ["lv", "im", "st", "lt", "priority", "response_time"], [
    (lv, "|".join(fv.ACTIONS[lv]["immediate"]), "|".join(fv.ACTIONS[lv]["short_term"]), "|".join(fv.ACTIONS[lv]["long_term"]),
     fv.ACTION_PRIORITY[lv], fv.ACTION_RESPONSE_TIME[lv]) for lv in fv.ACTIONS])
EXTRA_SQL = S.values("ext", ["k", "x"], [(k, "|" + "|".join(v)) for k, v in fv.ATTACK_IMMEDIATE_ACTIONS.items()])


@query("j07_action_lookup", f"""WITH {ACT_SQL}, {EXTRA_SQL}, {S.ALERTS_ENRICHED}, l AS (SELECT attack_type,
  CASE event_id % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low' ELSE 'Other' END AS risk_level FROM alerts)
SELECT attack_type, risk_level, im || coalesce(x, '') AS immediate, st AS short_term, lt AS long_term, priority, response_time, count(*) AS n
FROM l JOIN act ON lv = CASE WHEN risk_level = 'Other' THEN 'Low' ELSE risk_level END
LEFT JOIN ext ON lower(attack_type) = k GROUP BY ALL""")
def j07(spark, sf):
    level = F.expr("case cast(substr(flow_id, 6) as bigint) % 5 when 0 then 'Critical' when 1 then 'High' "
                   "when 2 then 'Medium' when 3 then 'Low' else 'Other' end")
    a = al.enrich(tb.alerts(spark, sf)).select("attack_type", level.alias("risk_level"))
    counted = a.groupBy("attack_type", "risk_level").agg(F.count("*").alias("n"))
    out = sv.with_actions(counted, "risk_level", "attack_type")
    return out.withColumns({c: F.array_join(c, "|") for c in fv.ACTION_TIMEFRAMES})


@query("j08_report_actions", f"""WITH {_REPORT_ACTIONS}, {S.ALERTS_ENRICHED}
SELECT severity, action, timeframe, count(*) AS n FROM alerts JOIN act USING (severity) GROUP BY ALL""")
def j08(spark, sf):
    return al.enrich(tb.alerts(spark, sf)).join(F.broadcast(sv.report_action_table(spark)), "severity", "left").groupBy(
        "severity", "action", "timeframe").agg(F.count("*").alias("n"))


@query("j09_features_with_metadata", f"""WITH {S.ALERTS}
SELECT src_ip, count(*) AS n, round(sum(detection_time), 6) AS total_time FROM alerts0 GROUP BY 1""")
def j09(spark, sf):
    meta, feats = cl.split_metadata(tb.alerts(spark, sf))
    return feats.join(meta, "flow_id").groupBy("src_ip").agg(
        F.count("*").alias("n"), F.round(F.sum("detection_time"), 6).alias("total_time"))


@query("j10_verified_with_times", f"""WITH {S.VERIFS}
SELECT v.flow_id, t.analysis_time FROM active v LEFT JOIN (SELECT * FROM active WHERE analysis_time BETWEEN 2 AND 300) t
ON v.flow_id = t.flow_id""")
def j10(spark, sf):
    v = vf.active(tb.verifications(spark, sf))
    times = v.filter(F.col("analysis_time").between(2, 300)).select("flow_id", "analysis_time")
    return v.select("flow_id").join(times, "flow_id", "left")


@query("j11_automated_time", f"""WITH {S.VERIFS}, {S.ALERTS_ENRICHED}
SELECT attack_type, count(*) AS n, round(coalesce(avg(detection_time) FILTER (n_agreeing > 0), 0.05), 6) AS automated_time
FROM active v JOIN alerts a ON v.flow_id = a.flow_id GROUP BY 1""")
def j11(spark, sf):
    a = al.enrich(tb.alerts(spark, sf))
    times = a.filter("n_agreeing > 0").select("flow_id", "detection_time")
    v = vf.verified_alerts(a, tb.verifications(spark, sf)).drop("detection_time")
    return v.join(times, "flow_id", "left").groupBy("attack_type").agg(
        F.count("*").alias("n"),
        F.round(F.coalesce(F.avg("detection_time"), F.lit(fv.DEFAULT_DETECTION_SECONDS)), 6).alias("automated_time"))


@query("j13_rows_with_global_stats", f"""WITH {S.ALERTS}, s AS (SELECT avg(detection_time) AS m, stddev_samp(detection_time) AS d FROM alerts0)
SELECT flow_id, round((detection_time - m) / d, 6) AS z FROM alerts0, s""")
def j13(spark, sf):
    a = tb.alerts(spark, sf)
    s = st.lazy(a, m=F.avg("detection_time"), d=F.stddev_samp("detection_time"))
    return a.select("flow_id", F.round(nm.zscore(F.col("detection_time"), s["m"], s["d"]), 6).alias("z"))


@query("j14_type_matches", f"""WITH {S.SCORED} SELECT model, count(*) AS n FROM scored WHERE y_true = y_pred AND y_pred <> 1 GROUP BY 1""")
def j14(spark, sf):
    e = al.enrich(tb.flows(spark, sf))
    calls = al.prediction_map(F.col("true_is_threat"))
    return e.select("attack_type", F.explode(calls).alias("model", "p")).filter(
        F.col("p.predicted_threat") & (F.col("p.attack_label") == F.col("attack_type"))).groupBy("model").agg(
        F.count("*").alias("n"))
