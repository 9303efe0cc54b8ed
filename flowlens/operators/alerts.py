"""Scored flows to alerts, and the filters and texts analysts work with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from flowlens import fixed_values as fv
from flowlens.functions.lookup import literal_table, lookup
from flowlens.functions.text import fill
from flowlens.sources.tables import PREDICTION_COLUMNS

BENIGN_IDX = fv.CLASSES.index(fv.BENIGN)


def class_name(idx: Column) -> Column:
    """Class name by index; ``Attack_<i>`` beyond the known classes, ``Unknown`` for NULL."""
    names = F.array(*[F.lit(c) for c in fv.CLASSES])
    other = F.when(idx.isNull(), "Unknown").otherwise(F.concat(F.lit("Attack_"), idx.cast("string")))
    return F.coalesce(F.get(names, idx.cast("int")), other)


def is_threat(pred: Column) -> Column:
    return pred != BENIGN_IDX


def threat_votes(predictions: dict[str, str] = PREDICTION_COLUMNS) -> Column:
    return reduce(lambda a, b: a + b, [is_threat(F.col(c)).cast("int") for c in predictions.values()])


def majority(votes: Column) -> Column:
    return (votes >= 2).cast("int")


def vote_risk(votes: Column) -> Column:
    """High from two votes, Low from one, else None."""
    return F.when(votes >= 2, "High").when(votes == 1, "Low").otherwise("None")


def inherent_severity(label: Column) -> Column:
    return (
        F.when(label.isin(*fv.INHERENT_HIGH), "High")
        .when(label.isin(*fv.INHERENT_MEDIUM), "Medium")
        .when(label == fv.BENIGN, "Low")
        .otherwise("Medium")
    )


def adjusted_severity(label: Column, agreeing: Column) -> Column:
    """Inherent severity, lowered when no model agrees, raised when all three do."""
    base = inherent_severity(label)
    return (
        F.when(base == "High", F.when(agreeing >= 1, "High").otherwise("Medium"))
        .when(base == "Medium", F.when(agreeing >= 3, "High").when(agreeing >= 1, "Medium").otherwise("Low"))
        .otherwise("Low")
    )


def model_severity(label: Column, threat: Column) -> Column:
    """Severity of one model's own call."""
    listed = label.isin(*fv.INHERENT_HIGH, *fv.INHERENT_MEDIUM) | (label == fv.BENIGN)
    return F.when(listed, inherent_severity(label)).otherwise(F.when(threat, "Medium").otherwise("Low"))


def _pick(tests: dict[str, Column]) -> Column:
    """Names whose test holds, in model order."""
    return F.array_compact(F.array(*[F.when(t, F.lit(m)) for m, t in tests.items()]))


def agreeing_models(truth: Column, predictions: dict[str, str] = PREDICTION_COLUMNS) -> Column:
    """Models that named the same class; for benign flows the models that said benign."""
    return _pick({m: F.col(c) == truth for m, c in predictions.items()})


def voting_models(predictions: dict[str, str] = PREDICTION_COLUMNS) -> Column:
    """Models that called any threat class."""
    return _pick({m: is_threat(F.col(c)) for m, c in predictions.items()})


def _risk_sentence(label: Column, severity: Column, n: Column, total: int) -> Column:
    """Threat part of the narrative, by severity and number of agreeing models."""
    def sentence(level: str) -> Column:
        several, single, unseen = (fill(t, label=label, n=n.cast("string"), total=F.lit(str(total))) for t in fv.RISK_SENTENCES[level])
        return F.when(n >= 2, several).when(n == 1, single).otherwise(unseen)

    return F.when(severity == "High", sentence("High")).when(severity == "Medium", sentence("Medium")).otherwise(sentence("Low"))


def risk_narrative(label: Column, severity: Column, agreeing: Column, total: int = 3) -> Column:
    """One-line explanation for streamed alerts."""
    return F.when(label == fv.BENIGN, fv.BENIGN_SENTENCE).otherwise(_risk_sentence(label, severity, agreeing, total))


def batch_risk_narrative(label: Column, severity: Column, votes: Column, models: Column, total: int = 3) -> Column:
    """Explanation for batch detection: vote counts plus the list of models."""
    n = F.size(models)
    names = F.array_join(models, ", ")
    some = fill(fv.BENIGN_BY_SOME, n=n.cast("string"), total=F.lit(str(total)))
    benign = F.when(n == total, fv.BENIGN_BY_ALL).when(n >= 1, some).otherwise(fv.BENIGN_BY_NONE)
    benign_tail = F.when(n > 0, fill(fv.BENIGN_TAIL, names=names)).otherwise(fv.BENIGN_TAIL_NONE)
    review, routine = (fill(fv.RISK_SENTENCES[level][2], label=label) for level in ("Medium", "Low"))
    unseen = F.when(label.isin(*fv.INHERENT_HIGH), review).otherwise(routine)
    threat = F.when(votes == 0, unseen).otherwise(_risk_sentence(label, severity, votes, total))
    threat_tail = F.when(n > 0, fill(fv.THREAT_TAIL, names=names)).otherwise("")
    return F.when(label == fv.BENIGN, F.concat(benign, benign_tail)).otherwise(F.concat(threat, threat_tail))


def prediction_map(truth_is_threat: Column, predictions: dict[str, str] = PREDICTION_COLUMNS) -> Column:
    """model -> (predicted_threat, predicted_label, attack_label, is_correct)."""
    pairs: list[Column] = []
    for model, c in predictions.items():
        threat = is_threat(F.col(c))
        pairs += [F.lit(model), F.struct(
            threat.alias("predicted_threat"), F.col(c).cast("int").alias("predicted_label"),
            class_name(F.col(c)).alias("attack_label"), (threat == truth_is_threat).alias("is_correct"))]
    return F.create_map(*pairs)


def _key_columns(df: DataFrame, least: int, most: int) -> dict[str, str]:
    """Display name -> column: the analyst features that exist, topped up with others when fewer than ``least``."""
    found = {name: c for name, c in fv.KEY_FEATURES.items() if c in df.columns}
    if len(found) < least:
        extra = [c for c in df.columns if c not in found.values()]
        found |= {c: c for c in extra[: most - len(found)]}
    return found


def key_features(df: DataFrame, least: int = 5, most: int = 10) -> Column:
    """Map of the analyst features that are numbers; text ones are in ``key_feature_texts``."""
    kinds = dict(df.dtypes)
    found = {n: c for n, c in _key_columns(df, least, most).items() if kinds[c] != "string"}
    pairs = [x for n, c in found.items() for x in (F.lit(n), F.col(f"`{c}`").try_cast("double"))]
    return F.map_filter(F.create_map(*pairs).cast("map<string,double>"), lambda _, v: v.isNotNull())


def key_feature_texts(df: DataFrame, least: int = 5, most: int = 10) -> Column:
    """Map of the analyst features that are text: numbers written as text stay text, as they came."""
    kinds = dict(df.dtypes)
    found = {n: c for n, c in _key_columns(df, least, most).items() if kinds[c] == "string"}
    pairs = [x for n, c in found.items() for x in (F.lit(n), F.col(f"`{c}`"))]
    return F.map_filter(F.create_map(*pairs).cast("map<string,string>"), lambda _, v: v.isNotNull())


def enrich(df: DataFrame, predictions: dict[str, str] = PREDICTION_COLUMNS) -> DataFrame:
    """Alert columns for scored flows: a single projection over the scored table.

    Counts and names come from comparisons, not from the model array, so filters
    and reports on them stay in generated code when Catalyst inlines them.
    """
    agrees = {m: F.col(c) == F.col("label_idx") for m, c in predictions.items()}
    n = reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(False)).cast("int") for t in agrees.values()])
    names = F.concat_ws(",", *[F.when(t, F.lit(m)) for m, t in agrees.items()])
    base = df.withColumns({
        "attack_type": class_name(F.col("label_idx")),
        "detection_models": agreeing_models(F.col("label_idx"), predictions),
        "n_agreeing": n,
        "model_used": F.when(n > 0, names).otherwise("Unknown"),
        "threat_votes": threat_votes(predictions),
    })
    return base.withColumns({
        "attack_label": F.col("attack_type"),
        "ensemble": majority(F.col("threat_votes")),
        "severity": adjusted_severity(F.col("attack_type"), F.col("n_agreeing")),
        "true_is_threat": F.col("attack_type") != fv.BENIGN,
    }).withColumn("risk_analysis", risk_narrative(F.col("attack_type"), F.col("severity"), F.col("n_agreeing")))


def alert_records(df: DataFrame, predictions: dict[str, str] = PREDICTION_COLUMNS) -> DataFrame:
    """Full nested alert record."""
    e = enrich(df, predictions)
    some = any(c in df.columns for c in fv.KEY_FEATURES.values())
    features = key_features(df) if some else F.create_map().cast("map<string,double>")
    texts = key_feature_texts(df) if some else F.create_map().cast("map<string,string>")
    time = F.col("detection_time") if "detection_time" in df.columns else F.lit(fv.DEFAULT_DETECTION_SECONDS)
    return e.select(
        "flow_id", "src_ip", "dst_ip", "attack_type", "attack_label", "severity", "model_used", "risk_analysis",
        F.col("ts").alias("timestamp"), "detection_models", "ensemble", "true_is_threat",
        prediction_map(F.col("true_is_threat"), predictions).alias("model_predictions"),
        time.alias("detection_time"), features.alias("key_features"), texts.alias("key_feature_texts"),
    )


# --- filters --------------------------------------------------------------------------
def is_valid_alert() -> Column:
    """Known attack type, and some model stands behind the alert."""
    used = F.lower(F.trim(F.coalesce("model_used", F.lit(""))))
    return (F.lower("attack_type") != "unknown") & ~used.isin("", "unknown", "simulated")


def is_benign(label: str = "attack_type") -> Column:
    return F.lower(F.col(label)) == "benign"


def recent(ts: Column, ref_ts: Column, minutes: int = 30) -> Column:
    """Within the last ``minutes`` before ``ref_ts``; a time that does not parse is out."""
    age = F.unix_micros(ref_ts.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return F.coalesce(age <= minutes * 60_000_000, F.lit(False))


def parse_iso(text: Column) -> Column:
    return F.try_to_timestamp(text)


def model_tokens(model_used: str = "model_used") -> Column:
    """Display names of the models in a comma list; placeholders removed."""
    parts = F.transform(F.split(F.coalesce(model_used, F.lit("")), ","), lambda m: F.trim(m))
    real = F.filter(parts, lambda m: ~F.lower(m).isin("", "unknown", "simulated"))
    return F.transform(real, lambda m: F.coalesce(lookup(fv.MODEL_DISPLAY_NAMES, F.lower(m)), m))


def filter_alerts(df: DataFrame, attack_types: list[str] | None = None, severity: str | None = None,
                  models: list[str] | None = None, verification: str | None = None,
                  verified: DataFrame | None = None) -> DataFrame:
    """Valid alerts by facets; the verification facet is a semi or anti join."""
    out = df.filter(is_valid_alert())
    if attack_types:
        out = out.filter(F.col("attack_type").isin(*attack_types))
    if severity:
        out = out.filter(F.lower("severity") == severity.lower())
    if models:
        wanted = F.array(*[F.lit(m) for m in models])
        out = out.filter(F.arrays_overlap(model_tokens(), wanted))
    if verification:
        how = {"verified": "left_semi", "unverified": "left_anti"}[verification]
        out = out.join(verified.select("flow_id"), "flow_id", how)
    return out


def unique_models(df: DataFrame) -> DataFrame:
    return df.select(F.explode(model_tokens()).alias("model")).distinct()


def unique_attack_types(df: DataFrame) -> DataFrame:
    return df.filter(is_valid_alert()).select("attack_type").distinct()


# --- analyst texts -----------------------------------------------------------------------
def short_number(x: Column) -> Column:
    """1.2M, 34K, 5.6."""
    return (
        F.when(x >= 1_000_000, F.concat(F.format_string("%.1f", x / 1_000_000), F.lit("M")))
        .when(x >= 1000, F.concat(F.format_string("%.0f", x / 1000), F.lit("K")))
        .otherwise(F.format_string("%.1f", x))
    )


def _value(df: DataFrame, c: str) -> Column:
    return F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")


def anomaly_tests(df: DataFrame) -> dict[str, tuple[Column, Column]]:
    """code -> (condition, explanation) for each traffic anomaly."""
    fwd, bwd = _value(df, "total_fwd_packets"), _value(df, "total_bwd_packets")
    dur, pps = _value(df, "flow_duration"), _value(df, "flow_packets_per_s")
    syn, ack = _value(df, "syn_flag_count"), _value(df, "ack_flag_count")
    fwd_bytes, push = _value(df, "total_fwd_bytes"), _value(df, "bwd_psh_flags")
    minutes = F.round(dur / 60, 0).cast("bigint")
    done = F.round(F.try_divide(ack * 100, syn), 0).cast("bigint")
    rate = F.try_divide(fwd_bytes, dur)
    ratio = F.round(fwd / F.when(bwd == 0, 1.0).otherwise(bwd), 0).cast("bigint")
    s = lambda c: c.cast("string")
    whole = lambda c: s(c.cast("bigint"))
    tests = {
        "asymmetry": (bwd < fwd * 0.15) & (fwd > 50), "continuous": (dur > 180) & (minutes >= 60),
        "persistent": (dur > 180) & (minutes > 10) & (minutes < 60), "incomplete": (syn > 10) & (done < 30),
        "exfiltration": (dur > 5) & (rate > 50_000), "burst": pps > 150, "push": (push > fwd * 0.15) & (fwd > 30),
    }
    values = {"ratio": s(ratio), "fwd": short_number(fwd), "bwd": whole(bwd), "minutes": s(minutes), "done": s(done), "syn": whole(syn),
              "ack": whole(ack), "bytes": short_number(fwd_bytes), "rate": short_number(rate), "pps": short_number(pps), "push": whole(push)}
    return {code: (test, fill(fv.ANOMALY_TEXTS[code], **values)) for code, test in tests.items()}


def anomaly_codes(df: DataFrame) -> Column:
    return F.array_compact(F.array(*[F.when(t, F.lit(code)) for code, (t, _) in anomaly_tests(df).items()]))


def top_features(df: DataFrame, k: int = 3) -> Column:
    """Names of the k largest analyst features by absolute value (above 0.001), largest first."""
    found = {name: F.abs(F.col(c).try_cast("double")) for name, c in fv.KEY_FEATURES.items() if c in df.columns}
    keyed = F.array_compact(F.array(*[
        F.when(v > 0.001, F.struct((-v).alias("k"), F.lit(name).alias("name"))) for name, v in found.items()]))
    return F.slice(F.sort_array(keyed), 1, k)["name"]


def anomaly_reasons(df: DataFrame, attack: Column) -> Column:
    """Array of explanations; a fallback sentence when no anomaly holds."""
    found = F.array_compact(F.array(*[F.when(t, text) for t, text in anomaly_tests(df).values()]))
    low = F.lower(attack)
    has = lambda *ks: reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in ks])
    first = F.get(top_features(df), F.lit(0))
    fallback = (
        F.when(low == "benign", "Normal balanced traffic")
        .when(has("hoax"), "False positive - benign pattern")
        .when(first.isNull(), "ML threat pattern detected")
        .when(has("backdoor", "exploit", "virus", "trojan", "worm"),
              F.concat(F.lit("HIGH RISK threat type - "), first, F.lit(" pattern detected")))
        .when(has("hacktool"), F.concat(F.lit("Tool usage detected via "), first))
        .otherwise(F.concat(first, F.lit(" pattern matching threat signatures")))
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(fallback))


def recommendation(df: DataFrame, attack: Column, model_used: Column) -> Column:
    """Attack-specific advice with a confidence suffix."""
    v = lambda c: _value(df, c)
    tests = {
        "virus_volume": (v("flow_bytes_per_s") > 500_000) | (v("total_fwd_bytes") > 1_000_000),
        "virus_spread": v("total_fwd_packets") > 5000,
        "trojan_c2": (v("bwd_psh_flags") > 30) & (v("flow_duration") > 3000),
        "long_lived": v("flow_duration") > 1800,
        "worm_spread": (v("total_fwd_packets") > 1000) | (v("flow_packets_per_s") > 200),
        "syn_heavy": v("syn_flag_count") > 100,
        "exfiltration": v("total_fwd_bytes") > 2_000_000,
    }
    low = F.lower(attack)

    def fill(text: str) -> Column:
        c = F.lit(text)
        for tag, name in (("{dst}", "dst_ip"), ("{src}", "src_ip")):
            c = F.replace(c, F.lit(tag), F.col(name)) if tag in text else c
        return c

    def choose(options: list[tuple[str | None, str]]) -> Column:
        out = fill(options[-1][1])
        for test, text in reversed(options[:-1]):
            out = F.when(F.coalesce(tests[test], F.lit(False)), fill(text)).otherwise(out)
        return out

    text = F.when(low == "benign", fv.RECOMMENDATION_BENIGN)
    for word, options in fv.RECOMMENDATIONS.items():
        text = text.when(F.contains(low, F.lit(word)), choose(options))
    text = text.otherwise(fill(fv.RECOMMENDATION_DEFAULT))
    n = F.size(F.filter(F.split(model_used, ","), lambda m: F.trim(m) != ""))
    suffix = F.when(low == "benign", "").otherwise(lookup(fv.RECOMMENDATION_SUFFIX, n, ""))
    return F.concat(text, suffix)


def headline(df: DataFrame, attack: Column, model_used: Column, models: int = 3) -> Column:
    """What an analyst reads first: the attack, how many models found it, and the advice on a second line."""
    n = F.size(F.filter(F.split(model_used, ","), lambda m: F.trim(m) != ""))
    found = F.format_string(fv.HEADLINE, attack, n, F.lit(models))
    return F.concat(found, F.lit("\n"), F.lit(fv.HEADLINE_ADVICE), recommendation(df, attack, model_used))


def verification_status(verdict: Column) -> Column:
    """State of an alert in the review queue."""
    used = F.lower(F.trim(F.coalesce("model_used", F.lit(""))))
    return (
        F.when(used.isin("", "unknown"), "Not detected")
        .when(F.lower(F.trim("attack_type")) == "benign", "Not verifiable")
        .when(verdict.isNull(), "Needs Review")
        .when(verdict, "Threat Confirmed")
        .otherwise("False Positive")
    )


def explain_features(df: DataFrame, features: str = "key_features") -> DataFrame:
    """One row per (flow, feature) with its description."""
    words = literal_table(df.sparkSession, ["feature", "description"], list(fv.FEATURE_DESCRIPTIONS.items()))
    return (
        df.select("flow_id", F.explode(features).alias("feature", "value"))
        .join(F.broadcast(words), "feature", "left")
        .withColumn("description", F.coalesce("description", F.lit(fv.FEATURE_DESCRIPTION_DEFAULT)))
    )
