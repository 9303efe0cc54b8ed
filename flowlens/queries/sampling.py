"""Splits, resampling, replay samples (M1-M4, J15, U1, ST9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import balance as bl, sampling as sp
from flowlens.queries import query
from flowlens.queries import sql as S
from flowlens.sources import tables as tb


def imbalanced(spark, sf):
    """Alerts with unequal classes: squares modulo 31 spread unevenly over four classes."""
    return tb.table(spark, sf, "events").selectExpr(
        "event_id", "cast(case when event_id % 100 < 60 then 0 when event_id % 100 < 90 then 1 when event_id % 100 < 97 then 2 else 3 end as int) as cls",
        "value")


_IMB = """imb AS (SELECT event_id, CAST(CASE WHEN event_id % 100 < 60 THEN 0 WHEN event_id % 100 < 90 THEN 1 WHEN event_id % 100 < 97 THEN 2 ELSE 3 END AS INT) AS cls, value FROM events),
cnt AS (SELECT cls, count(*) AS n FROM imb GROUP BY 1)"""


def _resample_sql(target: str) -> str:
    """Draw j of class c hits the row with index hash(c, j) mod n in md5 order."""
    return f"""WITH {_IMB}, tg AS (SELECT cls, n, CAST({target} AS BIGINT) AS target FROM cnt),
rows_ AS (SELECT i.*, row_number() OVER (PARTITION BY cls ORDER BY md5(event_id || '#42')) - 1 AS row_idx FROM imb i),
dr AS (SELECT cls, n, unnest(range(target)) AS j FROM tg WHERE target > 0),
hit AS (SELECT cls, ('0x' || substr(md5(cls || ':' || j || '#42'), 1, 12))::BIGINT % n AS row_idx, count(*) AS copies FROM dr GROUP BY 1, 2)
SELECT event_id, r.cls, copies FROM rows_ r JOIN hit h ON r.cls = h.cls AND r.row_idx = h.row_idx
UNION ALL SELECT event_id, r.cls, 1 FROM rows_ r JOIN tg USING (cls) WHERE target IS NULL"""


@query("m01_train_test_split", f"""WITH {S.FLOWS}, s AS (SELECT label_idx, CASE WHEN ('0x' || substr(md5(flow_id || '#42'), 1, 8))::BIGINT / 4294967296.0e0 < 0.3 THEN 1 ELSE 0 END AS t FROM flows),
c AS (SELECT label_idx, count(*) FILTER (t = 0) AS n_train, count(*) FILTER (t = 1) AS n_test FROM s GROUP BY 1)
SELECT *, n_test < greatest(100, 0.01 * sum(n_test) OVER ()) AS small_class FROM c""")
def m01(spark, sf):
    return sp.split_report(sp.split_hash(tb.flows(spark, sf), "flow_id"), "label_idx")


@query("m01_exact_split_report", f"""WITH {S.ALERTS}, r AS (SELECT label_idx, row_number() OVER (PARTITION BY label_idx ORDER BY md5(flow_id || '#42')) <= floor(0.3e0 * count(*) OVER (PARTITION BY label_idx) + 0.5e0) AS t FROM alerts0),
c AS (SELECT label_idx, count(*) FILTER (NOT t) AS n_train, count(*) FILTER (t) AS n_test FROM r GROUP BY 1)
SELECT *, n_test < greatest(100, 0.01 * sum(n_test) OVER ()) AS small_class FROM c""")
def m01_exact(spark, sf):
    return sp.split_report(sp.split_exact(tb.alerts(spark, sf), "flow_id", "label_idx"), "label_idx")


@query("m02_minority_upsample", _resample_sql(
    "CASE WHEN (SELECT max(n) / min(n) FROM cnt) > 5 AND n < greatest(floor((SELECT max(n) FROM cnt) * 0.2), 100) THEN greatest(floor((SELECT max(n) FROM cnt) * 0.2), 100) END"))
def m02(spark, sf):
    return bl.resample(imbalanced(spark, sf), "event_id", "cls", "minority").select("event_id", "cls", "copies")


@query("m03_median_rebalance", _resample_sql(
    "CASE WHEN (SELECT min(n) / max(n) FROM cnt) <= 0.9 THEN floor((SELECT median(n) FROM cnt)) END"))
def m03(spark, sf):
    return bl.resample(imbalanced(spark, sf), "event_id", "cls", "median").select("event_id", "cls", "copies")


@query("m04_tiered_rebalance", _resample_sql(
    "CASE WHEN (SELECT max(n) / min(n) FROM cnt) > 10 THEN floor((SELECT min(n) FROM cnt) * 1.5) WHEN (SELECT max(n) / min(n) FROM cnt) > 5 THEN floor((SELECT min(n) FROM cnt) * 1.2) "
    "WHEN (SELECT max(n) / min(n) FROM cnt) > 2 THEN floor((SELECT max(n) + min(n) FROM cnt) / 2) END"))
def m04(spark, sf):
    return bl.resample(imbalanced(spark, sf), "event_id", "cls", "tiered").select("event_id", "cls", "copies")


@query("j15_bootstrap_draws", f"""WITH {_IMB}, dr AS (SELECT cls, n, unnest(range(n)) AS j FROM cnt),
hit AS (SELECT cls, ('0x' || substr(md5(cls || ':' || j || '#42'), 1, 12))::BIGINT % n AS row_idx, count(*) AS copies FROM dr GROUP BY 1, 2),
r AS (SELECT event_id, value, cls, row_number() OVER (PARTITION BY cls ORDER BY md5(event_id || '#42')) - 1 AS row_idx FROM imb)
SELECT event_id, r.cls, r.row_idx, copies FROM r JOIN hit ON r.cls = hit.cls AND r.row_idx = hit.row_idx""")
def j15(spark, sf):
    df = imbalanced(spark, sf)
    plan = df.groupBy("cls").agg(F.count("*").alias("n")).withColumn("target", F.col("n"))
    drawn = bl.draws(plan, "cls", 42)
    return sp.numbered(df, "event_id", "cls").join(drawn, ["cls", "row_idx"]).select("event_id", "cls", "row_idx", "copies")


@query("u01_union_resampled", f"SELECT cls, CAST(sum(copies) AS BIGINT) AS n FROM ({_resample_sql('CASE WHEN (SELECT min(n) / max(n) FROM cnt) <= 0.9 THEN floor((SELECT median(n) FROM cnt)) END')}) GROUP BY 1")
def u01(spark, sf):
    return bl.expand(bl.resample(imbalanced(spark, sf), "event_id", "cls", "median")).groupBy("cls").agg(F.count("*").alias("n"))


# Copies: how many partial sums of the Poisson probabilities the hashed uniform reaches.
@query("m02_poisson_upsample", f"""WITH {_IMB}, tg AS (SELECT cls, CASE WHEN (SELECT max(n) / min(n) FROM cnt) > 5 AND n < greatest(floor((SELECT max(n) FROM cnt) * 0.2), 100)
  THEN greatest(floor((SELECT max(n) FROM cnt) * 0.2), 100) / n END AS rate FROM cnt),
cdf AS (SELECT cls, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY cls ORDER BY k) AS cdf FROM tg, range(0, 400) t(k) WHERE rate IS NOT NULL),
u AS (SELECT event_id, cls, ('0x' || substr(md5(event_id || '#42'), 1, 8))::BIGINT / 4294967296.0e0 AS u FROM imb),
c AS (SELECT event_id, u.cls, count(*) AS copies FROM u JOIN cdf ON u.cls = cdf.cls AND u.u >= cdf.cdf GROUP BY 1, 2
  UNION ALL SELECT event_id, u.cls, 1 FROM u JOIN tg ON u.cls = tg.cls WHERE rate IS NULL)
SELECT cls, CAST(sum(copies) AS BIGINT) AS n, count(*) AS distinct_rows FROM c GROUP BY 1""")
def m02_poisson(spark, sf):
    """Shuffle-free form: class sizes are close to the targets, not equal to them."""
    r = bl.resample_poisson(imbalanced(spark, sf), "event_id", "cls", "minority")
    return r.groupBy("cls").agg(F.sum("copies").alias("n"), F.count("*").alias("distinct_rows"))


@query("st09_replay_sample", f"""WITH {S.ALERTS}, t AS (SELECT flow_id, label_idx, CAST(floor(('0x' || substr(md5(flow_id || '#43'), 1, 8))::BIGINT / 4294967296.0e0 * 3) AS INT) AS third,
  md5(flow_id || '#42') AS h FROM alerts0), r AS (SELECT *, row_number() OVER (PARTITION BY third ORDER BY h) AS rn FROM t)
SELECT flow_id, label_idx FROM r WHERE rn <= 5000 // 3 + CASE WHEN third = 0 THEN 5000 - 3 * (5000 // 3) ELSE 0 END""")
def st09(spark, sf):
    return sp.sample_thirds(tb.alerts(spark, sf), "flow_id", 5000).select("flow_id", "label_idx")
