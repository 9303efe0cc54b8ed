"""SQL text shared by the DuckDB twins."""

from __future__ import annotations

from flowlens import fixed_values as fv


def q(v) -> str:
    """SQL literal of a fixed value."""
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, list):
        return "[" + ", ".join(q(x) for x in v) + "]"
    return repr(v)


def values(name: str, columns: list[str], rows) -> str:
    """A CTE holding fixed rows."""
    body = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


def in_list(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


LABELS = values("labels9", ["idx", "name"], list(enumerate(fv.CLASSES)))

FLOWS = """flows0 AS (SELECT
  'flow_' || l_orderkey || '_' || l_linenumber AS flow_id,
  '10.0.' || (l_suppkey % 256) || '.' || l_linenumber AS src_ip,
  '192.168.' || (l_partkey % 256) || '.' || (l_orderkey % 256) AS dst_ip,
  CAST((l_orderkey * 7) % 65536 AS INT) AS src_port, CAST((l_partkey * 13) % 65536 AS INT) AS dst_port,
  l_shipdate AS ts,
  CASE l_linenumber % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END AS protocol,
  (l_quantity - 1) * 90.0e0 AS flow_duration,
  CAST((l_partkey * 7 + l_linenumber * 211) % 1500 AS DOUBLE) AS packet_length_mean,
  l_extendedprice * 25 AS flow_bytes_per_s, l_extendedprice / 40 AS flow_packets_per_s,
  CAST(l_quantity AS INT) * 3 AS total_fwd_packets, CAST(l_partkey % 40 AS INT) AS total_bwd_packets,
  CAST(l_linenumber % 2 AS INT) AS fin_flag_count, CAST(l_orderkey % 5 AS INT) AS syn_flag_count,
  CAST(l_partkey % 3 AS INT) AS rst_flag_count, CAST(l_suppkey % 4 AS INT) AS psh_flag_count,
  CAST(CAST(l_quantity AS INT) % 6 AS INT) AS ack_flag_count,
  CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS urg_flag_count,
  l_discount * 10 AS flow_iat_mean, l_tax * 10 AS fwd_iat_mean, l_discount * 5 + l_tax AS bwd_iat_mean,
  CAST(CASE WHEN l_partkey % 20 < 9 THEN l_partkey % 20 ELSE 1 END AS INT) AS label_idx
  FROM lineitem),
flows AS (SELECT *,
  CAST(CASE WHEN (src_port + syn_flag_count) % 7 = 0 THEN (label_idx + 1) % 9 ELSE label_idx END AS INT) AS pred_aca_svm,
  CAST(CASE WHEN (src_port + dst_port) % 5 = 0 THEN (label_idx + 4) % 9 ELSE label_idx END AS INT) AS pred_fuzzy_rf,
  CAST(CASE WHEN dst_port % 11 = 0 THEN 1 ELSE label_idx END AS INT) AS pred_intrudtree
  FROM flows0)"""

ALERTS = """alerts0 AS (SELECT
  event_id, 'flow_' || event_id AS flow_id, ts, CAST(event_id % 9 AS INT) AS label_idx,
  CAST(CASE WHEN event_id % 4 = 0 THEN 1 ELSE event_id % 9 END AS INT) AS pred_aca_svm,
  CAST(CASE WHEN event_id % 5 = 0 THEN (event_id + 3) % 9 ELSE event_id % 9 END AS INT) AS pred_fuzzy_rf,
  CAST(CASE WHEN event_id % 6 = 0 THEN 1 ELSE event_id % 9 END AS INT) AS pred_intrudtree,
  '10.0.0.' || (user_id % 256) AS src_ip, '192.168.1.' || (event_id % 50) AS dst_ip,
  value / 1000 AS detection_time FROM events)"""

VERIFS = """verifs AS (SELECT 'flow_' || event_id AS flow_id, ts AS verified_at,
  CASE WHEN event_id % 30 = 0 THEN NULL WHEN event_id % 4 = 1 THEN false ELSE true END AS is_threat,
  value AS analysis_time FROM events WHERE event_id % 3 = 0),
active AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY verified_at DESC) AS rn
  FROM verifs) WHERE rn = 1 AND is_threat IS NOT NULL)"""


def enriched(source: str, out: str = "alerts") -> str:
    """Alert columns over a scored CTE, written with plain joins and CASE."""
    high, medium = in_list(fv.INHERENT_HIGH), in_list(fv.INHERENT_MEDIUM)
    return f"""{LABELS},
{out}_1 AS (SELECT s.*, l.name AS attack_type,
  CAST(pred_aca_svm <> 1 AS INT) + CAST(pred_fuzzy_rf <> 1 AS INT) + CAST(pred_intrudtree <> 1 AS INT) AS threat_votes,
  CAST(pred_aca_svm = label_idx AS INT) + CAST(pred_fuzzy_rf = label_idx AS INT)
    + CAST(pred_intrudtree = label_idx AS INT) AS n_agreeing,
  concat_ws(',', CASE WHEN pred_aca_svm = label_idx THEN 'ACA_SVM' END,
    CASE WHEN pred_fuzzy_rf = label_idx THEN 'Fuzzy_RF' END,
    CASE WHEN pred_intrudtree = label_idx THEN 'IntruDTree' END) AS names
  FROM {source} s JOIN labels9 l ON s.label_idx = l.idx),
{out} AS (SELECT *, CASE WHEN n_agreeing = 0 THEN 'Unknown' ELSE names END AS model_used,
  CASE WHEN threat_votes >= 2 THEN 1 ELSE 0 END AS ensemble, attack_type <> 'Benign' AS true_is_threat,
  CASE WHEN attack_type = 'Benign' THEN 'Low'
       WHEN attack_type IN {high} THEN CASE WHEN n_agreeing > 0 THEN 'High' ELSE 'Medium' END
       WHEN attack_type IN {medium} THEN CASE WHEN n_agreeing = 3 THEN 'High' WHEN n_agreeing > 0 THEN 'Medium' ELSE 'Low' END
       ELSE CASE WHEN n_agreeing = 3 THEN 'High' WHEN n_agreeing > 0 THEN 'Medium' ELSE 'Low' END END AS severity
  FROM {out}_1)"""


ALERTS_ENRICHED = f"{ALERTS},\n{enriched('alerts0')}"
FLOW_ALERTS = f"{FLOWS},\n{enriched('flows')}"

VALID = "lower(attack_type) <> 'unknown' AND lower(trim(model_used)) NOT IN ('', 'unknown', 'simulated')"

PREDICTIONS = [("ACA_SVM", "pred_aca_svm"), ("Fuzzy_RF", "pred_fuzzy_rf"), ("IntruDTree", "pred_intrudtree")]


def scored(source: str, extra: str = "") -> str:
    """One row per (row, model): model, y_true, y_pred."""
    parts = [f"SELECT '{m}' AS model, label_idx AS y_true, {c} AS y_pred{extra} FROM {source}" for m, c in PREDICTIONS]
    return "scored AS (" + " UNION ALL ".join(parts) + ")"


SCORED = f"{FLOWS},\n{scored('flows')}"
