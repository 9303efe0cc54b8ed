"""Flow, alert and verification views over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _exprs(df: DataFrame, **exprs: str) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in exprs.items()])


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network flows from ``lineitem``; a bag, so ``flow_id`` may repeat."""
    base = _exprs(
        table(spark, sf_dir, "lineitem"),
        flow_id="concat('flow_', cast(l_orderkey as string), '_', cast(l_linenumber as string))",
        src_ip="concat('10.0.', cast(l_suppkey % 256 as string), '.', cast(l_linenumber as string))",
        dst_ip="concat('192.168.', cast(l_partkey % 256 as string), '.', cast(l_orderkey % 256 as string))",
        src_port="cast((l_orderkey * 7) % 65536 as int)",
        dst_port="cast((l_partkey * 13) % 65536 as int)",
        ts="l_shipdate",
        protocol="case l_linenumber % 3 when 0 then 6 when 1 then 17 else 1 end",
        flow_duration="(l_quantity - 1) * 90.0D",
        packet_length_mean="cast((l_partkey * 7 + l_linenumber * 211) % 1500 as double)",
        flow_bytes_per_s="l_extendedprice * 25",
        flow_packets_per_s="l_extendedprice / 40",
        total_fwd_packets="cast(l_quantity as int) * 3",
        total_bwd_packets="cast(l_partkey % 40 as int)",
        fin_flag_count="cast(l_linenumber % 2 as int)",
        syn_flag_count="cast(l_orderkey % 5 as int)",
        rst_flag_count="cast(l_partkey % 3 as int)",
        psh_flag_count="cast(l_suppkey % 4 as int)",
        ack_flag_count="cast(cast(l_quantity as int) % 6 as int)",
        urg_flag_count="case when l_partkey % 50 = 0 then 1 else 0 end",
        flow_iat_mean="l_discount * 10",
        fwd_iat_mean="l_tax * 10",
        bwd_iat_mean="l_discount * 5 + l_tax",
        label_idx="cast(case when l_partkey % 20 < 9 then l_partkey % 20 else 1 end as int)",
    )
    return base.selectExpr(
        "*",
        "cast(case when (src_port + syn_flag_count) % 7 = 0 then (label_idx + 1) % 9 else label_idx end as int) as pred_aca_svm",
        "cast(case when (src_port + dst_port) % 5 = 0 then (label_idx + 4) % 9 else label_idx end as int) as pred_fuzzy_rf",
        "cast(case when dst_port % 11 = 0 then 1 else label_idx end as int) as pred_intrudtree",
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored flows from ``events``: unique ``flow_id`` and real timestamps."""
    return _exprs(
        table(spark, sf_dir, "events"),
        flow_id="concat('flow_', cast(event_id as string))",
        ts="ts",
        label_idx="cast(event_id % 9 as int)",
        pred_aca_svm="cast(case when event_id % 4 = 0 then 1 else event_id % 9 end as int)",
        pred_fuzzy_rf="cast(case when event_id % 5 = 0 then (event_id + 3) % 9 else event_id % 9 end as int)",
        pred_intrudtree="cast(case when event_id % 6 = 0 then 1 else event_id % 9 end as int)",
        src_ip="concat('10.0.0.', cast(user_id % 256 as string))",
        dst_ip="concat('192.168.1.', cast(event_id % 50 as string))",
        detection_time="value / 1000",
    )


def verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst verdict events; a NULL verdict withdraws an earlier one."""
    return _exprs(
        table(spark, sf_dir, "events").filter("event_id % 3 = 0"),
        flow_id="concat('flow_', cast(event_id as string))",
        verified_at="ts",
        is_threat="case when event_id % 30 = 0 then null when event_id % 4 = 1 then false else true end",
        analysis_time="value",
    )


# Column name of each model's predicted class index.
PREDICTION_COLUMNS = {
    "ACA_SVM": "pred_aca_svm",
    "Fuzzy_RF": "pred_fuzzy_rf",
    "IntruDTree": "pred_intrudtree",
}
