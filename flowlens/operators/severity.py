"""Severity, behaviour, risk, impact and action enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens import fixed_values as fv
from flowlens.functions import numeric as nm
from flowlens.functions.lookup import literal_table, lookup


# --- severity of a threat type -------------------------------------------------
def severity_table(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ["threat_type", "base_severity"], list(fv.THREAT_SEVERITY.items()))


def base_severity(threat_type: Column) -> Column:
    return lookup(fv.THREAT_SEVERITY, F.lower(threat_type), fv.THREAT_SEVERITY_DEFAULT)


# --- behaviour indicators -------------------------------------------------------
BATCH_INDICATORS = {
    "high_byte_rate": lambda: F.avg("flow_bytes_per_s") > 1_000_000,
    "high_packet_rate": lambda: F.avg("flow_packets_per_s") > 1000,
    "short_flow_duration": lambda: F.avg("flow_duration") < 1,
    "large_packet_size": lambda: F.avg("packet_length_mean") > 1400,
    "high_flag_count": lambda: F.avg(nm.row_sum([F.col(c) for c in fv.FLAG_COLUMNS])) > 5,
}


def behavior_indicators(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Boolean indicators from the means of a batch, or of each group in it."""
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(*[test().alias(name) for name, test in BATCH_INDICATORS.items()])


def behavior_score(indicators: dict[str, Column]) -> Column:
    """Weighted severity of the indicators that are present (non-null).

    An indicator that is present but false adds its weight to the denominator only.
    """
    if not indicators:
        return F.lit(0.0)
    gained, weight = [], []
    for name, c in indicators.items():
        w, level = fv.BEHAVIOR_INDICATORS[name]
        value = F.coalesce(c.cast("double"), F.lit(0.0))
        gained.append(F.lit(w * fv.INDICATOR_SEVERITY_SCORE[level]) * value)
        weight.append(F.when(c.isNotNull(), F.lit(w)).otherwise(0.0))
    add = lambda a, b: a + b
    return nm.safe_div(reduce(add, gained), reduce(add, weight))


def behavior_level(score: Column) -> Column:
    return F.when(score > 0.7, "High").when(score > 0.4, "Medium").otherwise("Low")


def assign_severity(threat_type: Column, indicators: dict[str, Column] | None = None) -> Column:
    """Behaviour decides when indicators are given, else the threat type."""
    return behavior_level(behavior_score(indicators)) if indicators else base_severity(threat_type)


# --- risk -------------------------------------------------------------------------
def risk_score(severity: Column, attack_type: Column, external: Column, critical: Column,
               protocol: Column) -> Column:
    w = fv.RISK_WEIGHTS
    place = F.least(F.lit(1.0), F.when(external, fv.RISK_EXTERNAL_SOURCE).otherwise(0.0)
                    + F.when(critical, fv.RISK_CRITICAL_DESTINATION).otherwise(0.0))
    return (
        lookup(fv.RISK_SEVERITY, severity, fv.RISK_SEVERITY_DEFAULT) * w["severity"]
        + lookup(fv.RISK_ATTACK, F.lower(attack_type), fv.RISK_ATTACK_DEFAULT) * w["attack_type"]
        + place * w["source_destination"]
        + lookup(fv.RISK_PROTOCOL, F.lower(protocol), fv.RISK_PROTOCOL_DEFAULT) * w["protocol"]
    )


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.8, "Critical").when(score >= 0.6, "High").when(score >= 0.4, "Medium").otherwise("Low")


def impact_table(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ["attack_key", *[f"{d}_impact" for d in fv.IMPACT_DIMENSIONS]],
                         [(a, *levels) for a, levels in fv.IMPACT_LEVELS.items()])


def with_impact(df: DataFrame, attack_col: str) -> DataFrame:
    """Four impact columns by a left join with the fixed attack table."""
    key = F.lower(F.col(attack_col))
    joined = df.join(F.broadcast(impact_table(df.sparkSession)), key == F.col("attack_key"), "left")
    filled = {f"{d}_impact": F.coalesce(f"{d}_impact", F.lit(fv.IMPACT_DEFAULT)) for d in fv.IMPACT_DIMENSIONS}
    return joined.withColumns(filled).drop("attack_key")


# --- actions ------------------------------------------------------------------------
def action_table(spark: SparkSession) -> DataFrame:
    rows = [(lv, *[fv.ACTIONS[lv][t] for t in fv.ACTION_TIMEFRAMES], fv.ACTION_PRIORITY[lv],
             fv.ACTION_RESPONSE_TIME[lv]) for lv in fv.ACTIONS]
    return literal_table(spark, ["action_level", "immediate", "short_term", "long_term", "priority",
                                 "response_time"], rows)


def attack_action_table(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ["attack_key", "extra"], list(fv.ATTACK_IMMEDIATE_ACTIONS.items()))


def with_actions(df: DataFrame, level_col: str, attack_col: str) -> DataFrame:
    """Action plan of the risk level, extended by attack-specific immediate actions.

    Both sides joined are fixed tables of four rows; an unknown level gets the Low plan.
    """
    spark = df.sparkSession
    known = F.when(F.col(level_col).isin(*fv.ACTIONS), F.col(level_col)).otherwise("Low")
    return (
        df.join(F.broadcast(action_table(spark)), known == F.col("action_level"), "left")
        .join(F.broadcast(attack_action_table(spark)), F.lower(F.col(attack_col)) == F.col("attack_key"), "left")
        .withColumn("immediate", F.concat("immediate", F.coalesce("extra", F.array().cast("array<string>"))))
        .drop("action_level", "attack_key", "extra")
    )


def report_action_table(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ["severity", "action", "description", "timeframe"],
                         [(s, *texts) for s, texts in fv.REPORT_ACTIONS.items()])


# --- composed analysis -----------------------------------------------------------------
def threat_type_from_scores(scores: list[Column]) -> Column:
    """Largest threat score in [0, 1]: above .8 malware, above .6 scan, else normal."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return F.when(top > 0.8, "malware").when(top > 0.6, "scan").otherwise("normal")


PROTOCOL_NAMES = {6: "tcp", 17: "udp", 1: "icmp"}  # IANA protocol numbers


def analyze(flows: DataFrame, by: list[str], predictions: dict[str, str], benign_idx: int) -> DataFrame:
    """Per-group threat analysis: scores, behaviour, severity, risk, impact, actions.

    One grouped aggregate over the flows; everything after it works on one row
    per group.
    """
    scores = {m: F.avg((F.col(c) != benign_idx).cast("double")) for m, c in predictions.items()}
    summary = flows.groupBy(*by).agg(
        *[c.alias(f"score_{m}") for m, c in scores.items()],
        *[test().alias(n) for n, test in BATCH_INDICATORS.items()],
        F.min("protocol").alias("__protocol"),
    )
    indicators = {n: F.col(n) for n in BATCH_INDICATORS}
    analyzed = summary.withColumns({
        "attack_type": threat_type_from_scores([F.col(f"score_{m}") for m in predictions]),
        "behavior_score": behavior_score(indicators),
        "protocol_name": lookup(PROTOCOL_NAMES, F.col("__protocol"), "tcp"),
    }).withColumn("severity", assign_severity(F.col("attack_type"), indicators)).withColumn(
        "risk_score", risk_score(F.col("severity"), F.col("attack_type"), F.lit(True), F.lit(False),
                                 F.col("protocol_name"))
    ).withColumn("risk_level", risk_level(F.col("risk_score"))).drop("__protocol")
    return with_actions(with_impact(analyzed, "attack_type"), "risk_level", "attack_type")
