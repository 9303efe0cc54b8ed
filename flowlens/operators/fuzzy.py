"""Rule scoring: deviation rules, quantile rules, fuzzy rules, prediction override."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from flowlens import fixed_values as fv
from flowlens.functions import membership as mb, numeric as nm, stats as st
from flowlens.functions.quantile import exact_quantiles
from flowlens.session import materialize

Stats = Column | dict[str, Any]


# --- deviation rules ---------------------------------------------------------
_SIGMA_COLUMNS = ["flow_duration", "packet_length_mean", "flow_bytes_per_s"]


def _flag_sum() -> Column:
    return nm.row_sum([F.col(c) for c in fv.FLAG_COLUMNS])


def _iat_mean() -> Column:
    return nm.row_mean([F.col(c) for c in fv.IAT_COLUMNS])


def sigma_stats(df: DataFrame, lazy: bool = True) -> Stats:
    inputs = {c: F.col(c) for c in _SIGMA_COLUMNS} | {"flags": _flag_sum(), "iat": _iat_mean()}
    aggs = {}
    for name, c in inputs.items():
        aggs[f"{name}__mean"], aggs[f"{name}__std"] = F.avg(c), F.stddev_samp(c)
    return st.lazy(df, **aggs) if lazy else st.fit(df, **aggs)


def sigma_points(stats: Stats) -> Column:
    """0-8 points: large deviations from the mean, few-flag and fast-arrival rules."""
    def beyond(name: str, k: int) -> Column:
        return st.stat(stats, f"{name}__mean") + k * st.stat(stats, f"{name}__std")

    points = [F.when(F.col(c) > beyond(c, 2), 2).when(F.col(c) > beyond(c, 1), 1).otherwise(0)
              for c in _SIGMA_COLUMNS]
    points.append(F.when(_flag_sum() > beyond("flags", 1), 1).otherwise(0))
    points.append(F.when(_iat_mean() < beyond("iat", -1), 1).otherwise(0))
    return reduce(lambda a, b: a + b, points)


def sigma_score(df: DataFrame, stats: Stats | None = None, span: Stats | None = None) -> DataFrame:
    """``fuzzy_points`` and its min-max form ``fuzzy_score`` (0 when all points are equal)."""
    pointed = df.withColumn("fuzzy_points", sigma_points(stats if stats is not None else sigma_stats(df)))
    if span is None:
        span = st.lazy(pointed, lo=F.min("fuzzy_points"), hi=F.max("fuzzy_points"))
    lo, hi = st.stat(span, "lo"), st.stat(span, "hi")
    return pointed.withColumn(
        "fuzzy_score", F.coalesce(F.try_divide((F.col("fuzzy_points") - lo).cast("double"), hi - lo), F.lit(0.0)))


# --- quantile rules ----------------------------------------------------------
_QUANTILES = {
    "packets_per_second": (0.9,), "bytes_per_second": (0.9,), "packet_count": (0.8,),
    "protocol_encoded": (0.95,), "avg_ttl": (0.1, 0.9),
}


def _stat_name(c: str, q: float) -> str:
    return f"{c}__{round(q * 100)}"


def quantile_stats(df: DataFrame, approx: bool = False) -> Stats:
    """Interpolated quantiles: exact ones are fitted in bounded memory, ``approx``
    ones stay in the plan as one aggregate."""
    wanted = {c: list(qs) for c, qs in _QUANTILES.items() if c in df.columns}
    if not approx:
        return {_stat_name(c, p): v for (c, p), v in exact_quantiles(df, wanted).items()}
    return st.lazy(df, **{_stat_name(c, p): F.percentile_approx(c, p, 10_000).cast("double")
                          for c, ps in wanted.items() for p in ps})


def quantile_score(df: DataFrame, stats: Stats | None = None) -> DataFrame:
    """``rule_score`` in [0, 1] and ``rule_label`` = score > 0.5."""
    stats = quantile_stats(df) if stats is None else stats
    q = lambda name: st.stat(stats, name)
    rules: list[tuple[str, Callable[[], Column], int]] = [
        ("packets_per_second", lambda: F.col("packets_per_second") > q("packets_per_second__90"), 3),
        ("bytes_per_second", lambda: F.col("bytes_per_second") > q("bytes_per_second__90"), 2),
        ("is_well_known_port", lambda: F.col("is_well_known_port") == 0, 2),
        ("flow_direction", lambda: F.col("flow_direction") == 2, 2),
        ("packet_count", lambda: F.col("packet_count") > q("packet_count__80"), 1),
        ("protocol_encoded", lambda: F.col("protocol_encoded") > q("protocol_encoded__95"), 2),
        ("avg_ttl", lambda: ~F.col("avg_ttl").between(q("avg_ttl__10"), q("avg_ttl__90")), 1),
    ]
    points = [F.when(test(), weight).otherwise(0) for c, test, weight in rules if c in df.columns]
    score = nm.clamp01(reduce(lambda a, b: a + b, points) / F.lit(13.0))
    return df.withColumn("rule_score", score).withColumn("rule_label", (F.col("rule_score") > 0.5).cast("int"))


# --- fuzzy rules -------------------------------------------------------------
@dataclass(frozen=True)
class FuzzyRule:
    """A rule is data: any of ``columns`` being high fires it with ``weight``."""

    name: str
    columns: tuple[str, ...]
    weight: float


RULES = tuple(FuzzyRule(n, (c,), w) for n, (c, w) in fv.FUZZY_RULES.items())

# Canonical flow column behind each rule input.
RULE_INPUTS = {
    "packets_per_second": "flow_packets_per_s",
    "bytes_per_second": "flow_bytes_per_s",
    "is_well_known_port": "is_well_known_dst",
}


def _input(df: DataFrame, feature: str) -> Column | None:
    for c in (feature, RULE_INPUTS.get(feature)):
        if c in df.columns:
            return F.col(c).cast("double")
    return None


def rule_strengths(df: DataFrame, rules: tuple[FuzzyRule, ...] = RULES) -> dict[str, Column]:
    """Firing strength per rule: the largest high degree among its inputs."""
    out = {}
    for r in rules:
        highs = [mb.degrees(c, x)["high"] for c in r.columns if (x := _input(df, c)) is not None]
        if highs:
            out[r.name] = F.greatest(F.lit(0.0), *[F.coalesce(h, F.lit(0.0)) for h in highs])
    return out


def fuzzy_score(df: DataFrame, rules: tuple[FuzzyRule, ...] = RULES) -> Column:
    """min(1, 2 * max(weighted sum, strongest rule)) in one expression."""
    strengths = rule_strengths(df, rules)
    weights = {r.name: r.weight for r in rules}
    if not strengths:
        return F.lit(0.0)
    total = reduce(lambda a, b: a + b, [s * F.lit(weights[n]) for n, s in strengths.items()])
    return nm.clamp01(F.greatest(total, *strengths.values()) * 2)


def threat_level(score: Column) -> Column:
    return F.when(score >= 0.8, 3).when(score >= 0.5, 2).when(score >= 0.2, 1).otherwise(0)


def with_fuzzy_features(df: DataFrame, rules: tuple[FuzzyRule, ...] = RULES) -> DataFrame:
    """Score and level, then the categories, risk bands and indicators read from the score."""
    scored = df.withColumn("fuzzy_score", fuzzy_score(df, rules))
    s = F.col("fuzzy_score")
    bands = {
        "fuzzy_low": s < 0.3, "fuzzy_medium": (s >= 0.3) & (s < 0.7), "fuzzy_high": s >= 0.7,
        "fuzzy_risk_low": s < 0.2, "fuzzy_risk_medium": (s >= 0.2) & (s < 0.6), "fuzzy_risk_high": s >= 0.6,
        "is_suspicious": s > 0.1, "threat_indicator_weak": s > 0.05,
        "threat_indicator_medium": s > 0.2, "threat_indicator_strong": s > 0.5,
    }
    return scored.withColumns({
        "fuzzy_threat_level": threat_level(s),
        "fuzzy_score_boosted": s * 10,
        **{name: test.cast("int") for name, test in bands.items()},
    })


FUZZY_FEATURES = [
    "fuzzy_score", "fuzzy_low", "fuzzy_medium", "fuzzy_high", "fuzzy_risk_low", "fuzzy_risk_medium",
    "fuzzy_risk_high", "fuzzy_score_boosted", "is_suspicious", "threat_indicator_weak",
    "threat_indicator_medium", "threat_indicator_strong",
]


def fuzzy_summary(df: DataFrame) -> DataFrame:
    """Distribution of ``fuzzy_score``: moments, median, risk counts, count above 0.6."""
    s = F.col("fuzzy_score")
    df = materialize(df.select("fuzzy_score"), "scores")
    median = exact_quantiles(df, {"fuzzy_score": [0.5]})["fuzzy_score", 0.5]
    return df.agg(
        F.avg(s).alias("mean_score"), F.stddev_samp(s).alias("std_score"), F.stddev_pop(s).alias("std_pop_score"),
        F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.lit(median).alias("median_score"),
        F.count_if(s < 0.2).alias("risk_low"), F.count_if((s >= 0.2) & (s < 0.6)).alias("risk_medium"),
        F.count_if(s >= 0.6).alias("risk_high"), F.count_if(s > 0.6).alias("high_fuzzy"),
    )


# --- override of benign predictions -------------------------------------------
def override_prediction(probs: Column, predicted: Column, fuzzy: Column,
                        benign_idx: int = fv.CLASSES.index(fv.BENIGN)) -> Column:
    """A benign call is replaced by the likeliest threat class when it is doubtful.

    Doubtful is p(benign) < 0.7 with the best threat at 20% of it or more; from
    0.7 on, a fuzzy score above 0.3.  Ties go to the lowest class index.
    """
    threats = F.transform(probs, lambda p, i: F.when(i == benign_idx, F.lit(-1.0)).otherwise(p))
    best_p = F.array_max(threats)
    best = (F.array_position(threats, best_p) - 1).cast("int")
    p_benign = F.get(probs, F.lit(benign_idx))
    doubtful = F.when(p_benign < 0.7, best_p >= p_benign * 0.2).otherwise(fuzzy > 0.3)
    return F.when((predicted == benign_idx) & doubtful, best).otherwise(predicted)


def override_statistics(df: DataFrame, before: str, after: str,
                        benign_idx: int = fv.CLASSES.index(fv.BENIGN)) -> DataFrame:
    b, a = F.col(before), F.col(after)
    return df.agg(
        F.count_if(b == benign_idx).alias("original_benign"), F.count_if(a == benign_idx).alias("final_benign"),
        F.count_if(b != benign_idx).alias("original_threats"), F.count_if(a != benign_idx).alias("final_threats"),
        F.count_if(a != b).alias("overrides"),
    )
