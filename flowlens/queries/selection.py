"""Feature scoring and selection (FS, T2, U2, W10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import fixed_values as fv
from flowlens.functions.quantile import exact_quantiles
from flowlens.operators import selection as fs
from flowlens.queries import query
from flowlens.queries import sql as S
from flowlens.queries.aggregates import rounded
from flowlens.sources import tables as tb

FEATURES = ["flow_duration", "packet_length_mean", "flow_bytes_per_s", "total_fwd_packets", "total_bwd_packets", "dst_port",
            "syn_flag_count", "rst_flag_count", "ack_flag_count", "flow_iat_mean"]
BINS = 20




_PER = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, label_idx, count(*) AS n, avg({f}) AS m, var_samp({f}) AS v, (SELECT avg({f}) FROM flows) AS g FROM flows GROUP BY label_idx" for f in FEATURES)
F_SQL = f"""{S.FLOWS}, per AS ({_PER}), fscore AS (SELECT feature, (sum(n * power(m - g, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f_score FROM per GROUP BY 1)"""


@query("fs1_anova_f", f"WITH {F_SQL} SELECT feature, round(f_score, 4) AS f_score FROM fscore")
def fs1(spark, sf):
    return rounded(fs.anova_f(tb.flows(spark, sf), FEATURES, "label_idx"), "f_score", digits=4)


def equal_bins(spark, sf):
    flows = tb.flows(spark, sf)
    return fs.binned_counts(flows, fs.equal_width_edges(flows, FEATURES, BINS), "label_idx")


# Number of the equal-width edges lying below the value.
_BIN = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST(len(list_filter(e{i}, lambda e: x > e)) AS INT) AS bin, label_idx AS label FROM (SELECT CAST({f} AS DOUBLE) AS x, label_idx, e{i} FROM flows, edges)"
    for i, f in enumerate(FEATURES))
BIN_SQL = f"""{S.FLOWS}, mm AS (SELECT {', '.join(f'min({f})::DOUBLE AS a{j}, max({f})::DOUBLE AS b{j}' for j, f in enumerate(FEATURES))} FROM flows),
edges AS (SELECT {', '.join(f'list_distinct(list_transform(range(1, {BINS}), lambda i: a{j} + (b{j} - a{j}) * i / {BINS})) AS e{j}' for j in range(len(FEATURES)))} FROM mm),
bins AS (SELECT feature, bin, label, count(*) AS n FROM ({_BIN}) GROUP BY ALL)"""


@query("fs2_mutual_information", f"""WITH {BIN_SQL}, t AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS b, sum(n) OVER (PARTITION BY feature, label) AS l FROM bins)
SELECT feature, round(sum(n / t * ln(n * t / (b * l))), 6) AS mi FROM t GROUP BY 1""")
def fs2(spark, sf):
    return rounded(fs.mutual_information(equal_bins(spark, sf)), "mi")


@query("fs2_quantile_binned_information", f"""WITH {S.FLOWS}, edges AS (SELECT {', '.join(f"list_distinct([{', '.join(f'quantile_cont({f}::DOUBLE, {i}/{BINS}.0e0)' for i in range(1, BINS))}]) AS e{j}" for j, f in enumerate(FEATURES))} FROM flows),
bins AS (SELECT feature, bin, label, count(*) AS n FROM ({_BIN}) GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS b, sum(n) OVER (PARTITION BY feature, label) AS l FROM bins)
SELECT feature, round(sum(n / t * ln(n * t / (b * l))), 5) AS mi FROM t GROUP BY 1""")
def fs2_quantile(spark, sf):
    """Equal-frequency bins from exact quantiles."""
    flows = tb.flows(spark, sf)
    found = exact_quantiles(flows, {f: [i / BINS for i in range(1, BINS)] for f in FEATURES})
    edges = {f: sorted({found[f, i / BINS] for i in range(1, BINS)}) for f in FEATURES}
    return rounded(fs.mutual_information(fs.binned_counts(flows, edges, "label_idx")), "mi", digits=5)


_CORR = " UNION ALL ".join(f"SELECT '{f}' AS feature, abs(corr({f}, label_idx)) AS corr FROM flows" for f in FEATURES)


@query("fs5_correlation", f"WITH {S.FLOWS}, c AS ({_CORR}) SELECT feature, round(corr, 6) AS corr FROM c ORDER BY round(corr, 6) DESC, feature LIMIT 5")
def fs5(spark, sf):
    return rounded(fs.top_k(fs.correlations(tb.flows(spark, sf), FEATURES, "label_idx"), "corr", 5), "corr")


_H = "-sum(CASE WHEN {t} > 0 THEN {x} / {t} * log2({x} / {t} + 1e-10) ELSE 0 END)"
SPLIT_SQL = f"""{BIN_SQL}, lab AS (SELECT DISTINCT label FROM bins), cuts AS (SELECT DISTINCT feature, bin AS cut FROM bins),
sp AS (SELECT c.feature, cut, l.label, coalesce(sum(n) FILTER (bin <= cut), 0)::DOUBLE AS nl, coalesce(sum(n) FILTER (bin > cut), 0)::DOUBLE AS nr
  FROM cuts c CROSS JOIN lab l LEFT JOIN bins b ON b.feature = c.feature AND b.label = l.label GROUP BY 1, 2, 3),
tot AS (SELECT *, sum(nl) OVER (PARTITION BY feature, cut) AS tl, sum(nr) OVER (PARTITION BY feature, cut) AS tr FROM sp),
qual AS (SELECT feature, cut, max(tl) AS n_left, max(tr) AS n_right, {_H.format(x='(nl + nr)', t='(tl + tr)')} - max(tl) / max(tl + tr) * ({_H.format(x='nl', t='tl')})
  - max(tr) / max(tl + tr) * ({_H.format(x='nr', t='tr')}) AS gain,
  max(tl) / max(tl + tr) * coalesce(1 - sum(power(nl / nullif(tl, 0), 2)), 0) + max(tr) / max(tl + tr) * coalesce(1 - sum(power(nr / nullif(tr, 0), 2)), 0) AS gini,
  count(*) FILTER (nl > 0) AS cl, count(*) FILTER (nr > 0) AS cr, max((nl + nr) / (tl + tr)) AS pu, coalesce(max(nl / nullif(tl, 0)), 0) AS pl, coalesce(max(nr / nullif(tr, 0)), 0) AS pr
  FROM tot GROUP BY 1, 2),
gain AS (SELECT feature, greatest(0, coalesce(max(gain) FILTER (n_left > 0 AND n_right > 0), 0)) AS gain FROM qual GROUP BY 1)"""


def quality(spark, sf):
    return fs.split_quality(fs.split_table(equal_bins(spark, sf)))


@query("fs9_information_gain", f"WITH {SPLIT_SQL} SELECT feature, round(gain, 6) AS gain FROM gain")
def fs9(spark, sf):
    return rounded(fs.information_gain(quality(spark, sf)), "gain")


@query("fs9_categorical_gain", f"""WITH {S.FLOWS}, c AS (SELECT protocol AS cut, label_idx AS label, count(*) AS n FROM flows GROUP BY 1, 2), v AS (SELECT DISTINCT cut FROM c), lab AS (SELECT label, sum(n) AS a FROM c GROUP BY 1),
sp AS (SELECT v.cut, lab.label, coalesce(c.n, 0)::DOUBLE AS nl, (a - coalesce(c.n, 0))::DOUBLE AS nr FROM v CROSS JOIN lab LEFT JOIN c ON c.cut = v.cut AND c.label = lab.label),
tot AS (SELECT *, sum(nl) OVER (PARTITION BY cut) AS tl, sum(nr) OVER (PARTITION BY cut) AS tr FROM sp),
g AS (SELECT cut, {_H.format(x='(nl + nr)', t='(tl + tr)')} - max(tl) / max(tl + tr) * ({_H.format(x='nl', t='tl')}) - max(tr) / max(tl + tr) * ({_H.format(x='nr', t='tr')}) AS gain FROM tot GROUP BY 1)
SELECT 'protocol' AS feature, round(greatest(0, max(gain)), 8) AS gain FROM g""")
def fs9_categorical(spark, sf):
    splits = fs.value_split_table(tb.flows(spark, sf), "protocol", "label_idx")
    return rounded(fs.information_gain(fs.split_quality(splits)), "gain", digits=8)


def _word(words) -> str:
    return "(" + " OR ".join(f"feature LIKE '%{w}%'" for w in words) + ")"


_DOM = f"feature IN {S.in_list(fv.DOMAIN_FEATURES)}"
_BONUS = f"""(CASE WHEN NOT {_DOM} THEN 1.0e0 WHEN {_word(fv.DOMAIN_BONUS[0][0])} THEN 2.0e0 WHEN {_word(fv.DOMAIN_BONUS[1][0])} THEN 1.8e0 ELSE 1.5e0 END
 * {' * '.join(f'CASE WHEN {_word(w)} THEN {m}e0 ELSE 1 END' for w, m in fv.NAME_BONUS)})"""


@query("fs10_domain_bonus", f"WITH {SPLIT_SQL} SELECT feature, round(gain, 6) AS gain, round(gain * {_BONUS}, 6) AS importance FROM gain")
def fs10(spark, sf):
    return rounded(fs.domain_bonus(fs.information_gain(quality(spark, sf)), "gain"), "gain", "importance")


_QUOTA = f"""{F_SQL}, m AS (SELECT feature, round(f_score, 4) AS f_score, {_DOM} AS domain FROM fscore), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY f_score DESC, feature) AS rk FROM m),
z AS (SELECT *, domain AND rk <= 3 AS reserved FROM r), w AS (SELECT *, sum(reserved::INT) OVER o AS f, sum((NOT reserved)::INT) OVER o AS oth FROM z WINDOW o AS (ORDER BY f_score DESC, feature))"""


@query("w10_quota_selection", f"WITH {_QUOTA} SELECT feature, f_score, domain, reserved FROM w WHERE reserved OR f + oth <= 6")
def w10(spark, sf):
    return fs.quota_selection(rounded(fs.anova_f(tb.flows(spark, sf), FEATURES, "label_idx"), "f_score", digits=4), "f_score", 6)


@query("fs11_quota_by_gain", f"""WITH {SPLIT_SQL}, m AS (SELECT feature, round(gain, 6) AS gain, {_DOM} AS domain FROM gain), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY gain DESC, feature) AS rk FROM m),
z AS (SELECT *, domain AND rk <= 2 AS reserved FROM r), w AS (SELECT *, sum(reserved::INT) OVER o AS f, sum((NOT reserved)::INT) OVER o AS oth FROM z WINDOW o AS (ORDER BY gain DESC, feature))
SELECT feature, gain, domain, reserved FROM w WHERE reserved OR f + oth <= 5""")
def fs11(spark, sf):
    return fs.quota_selection(rounded(fs.information_gain(quality(spark, sf)), "gain"), "gain", 5)


@query("t02_top_features", f"WITH {F_SQL} SELECT feature, round(f_score, 4) AS f_score FROM fscore ORDER BY round(f_score, 6) DESC, feature LIMIT 4")
def t02(spark, sf):
    return rounded(fs.top_k(fs.anova_f(tb.flows(spark, sf), FEATURES, "label_idx"), "f_score", 4), "f_score", digits=4)


@query("u02_selection_union", f"""WITH {F_SQL}, c AS ({_CORR}) SELECT feature FROM (SELECT feature FROM fscore ORDER BY round(f_score, 6) DESC, feature LIMIT 4)
UNION SELECT feature FROM (SELECT feature FROM c ORDER BY round(corr, 6) DESC, feature LIMIT 4)""")
def u02(spark, sf):
    flows = tb.flows(spark, sf)
    return fs.selection_union(fs.top_k(fs.anova_f(flows, FEATURES, "label_idx"), "f_score", 4),
                              fs.top_k(fs.correlations(flows, FEATURES, "label_idx"), "corr", 4))


@query("fs12_selection_summary", f"""WITH {F_SQL}, c AS ({_CORR}), s AS (SELECT 'anova' AS method, feature FROM (SELECT feature FROM fscore ORDER BY round(f_score, 6) DESC, feature LIMIT 4)
UNION ALL SELECT 'correlation', feature FROM (SELECT feature FROM c ORDER BY round(corr, 6) DESC, feature LIMIT 3))
SELECT method, count(*) AS n_features, string_agg(feature, ',' ORDER BY feature) AS features FROM s GROUP BY 1""")
def fs12(spark, sf):
    flows = tb.flows(spark, sf)
    return fs.selection_summary({"anova": fs.top_k(fs.anova_f(flows, FEATURES, "label_idx"), "f_score", 4),
                                 "correlation": fs.top_k(fs.correlations(flows, FEATURES, "label_idx"), "corr", 3)})


_BAL = "(least(n_left, n_right) / greatest(n_left, n_right))"


@query("fs13_split_scores", f"""WITH {SPLIT_SQL} SELECT feature, cut, round(CASE WHEN gain <= 0 THEN 0 ELSE greatest(gain * CASE WHEN cl > 1 AND cr > 1 THEN 1.3 WHEN cl > 1 OR cr > 1 THEN 1.1 ELSE 1.0 END
    * CASE WHEN {_BAL} > 0.2 THEN 1.2 WHEN {_BAL} > 0.1 THEN 1.0 ELSE 0.8 END + CASE WHEN (pl + pr) / 2 > pu THEN ((pl + pr) / 2 - pu) * 2 ELSE 0 END, 0.0001) END, 6) AS improved_score,
  round(gain * CASE WHEN {_DOM} THEN 1.3e0 ELSE 1 END * CASE WHEN {_word(['packet', 'flow', 'duration', 'rate'])} THEN 1.2e0 ELSE 1 END * CASE WHEN feature LIKE '%flag%' THEN 1.4e0 ELSE 1 END
    * CASE WHEN {_BAL} < 0.1 THEN 0.3e0 WHEN {_BAL} < 0.2 THEN 0.7e0 ELSE 1 END * CASE WHEN cl > 1 AND cr > 1 THEN 1.5e0 WHEN cl > 1 OR cr > 1 THEN 1.2e0 ELSE 1 END, 6) AS domain_score,
  round(gain - gini * 0.1, 6) AS combined_score FROM qual WHERE n_left > 0 AND n_right > 0""")
def fs13(spark, sf):
    s = fs.split_scores(quality(spark, sf)).select("feature", "cut", "improved_score", "domain_score", "combined_score")
    return rounded(s, "improved_score", "domain_score", "combined_score")
