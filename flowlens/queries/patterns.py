"""Signature scans over documents, pages and conversations (PM, J12, A35)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import features as ft, patterns as pt
from flowlens.queries import query
from flowlens.queries import sql as S
from flowlens.queries.features import TOKENS_SQL
from flowlens.sources import tables as tb

# Words that occur in the texts; none overlaps itself, so the SQL counts agree.
WORDS = ["the", "and", "tion", "ing", "que", "der", "ung", "password"]
P = S.values("p", ["pid", "pattern"], list(enumerate(WORDS)))


def docs(spark, sf):
    return tb.table(spark, sf, "documents").select("doc_id", "text")


def _n(text: str, p: str) -> str:
    return f"((length({text}) - length(replace({text}, {p}, ''))) // length({p}))"


@query("j12_text_contains", f"WITH {P} SELECT doc_id, pid AS pattern_id, pattern FROM documents, p WHERE contains(text, pattern)")
def j12(spark, sf):
    return pt.matching_patterns(docs(spark, sf), "text", WORDS)


@query("pm1_presence", f"SELECT doc_id, {', '.join(f'CAST(contains(lower(text), {S.q(w)}) AS INT) AS aca_binary_{i}' for i, w in enumerate(WORDS))} FROM documents")
def pm1(spark, sf):
    return pt.presence(docs(spark, sf), "text", WORDS, lower=True).drop("text")


def _positions_sql(source: str, key: str, text: str) -> str:
    """Positions from the running length of the pieces between occurrences."""
    return f"""WITH {P}, sp AS (SELECT {key}, pattern, string_split({text}, pattern) AS parts FROM {source}, p WHERE contains({text}, pattern)),
u AS (SELECT {key}, pattern, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) AS k FROM sp),
c AS (SELECT {key}, pattern, i, k, sum(length(part)) OVER (PARTITION BY {key}, pattern ORDER BY i) + (i - 1) * length(pattern) AS st FROM u)
SELECT {key}, CAST(st AS BIGINT) AS start, CAST(st + length(pattern) - 1 AS BIGINT) AS "end", pattern FROM c WHERE i < k"""


@query("pm2_positions", _positions_sql("documents", "doc_id", "text"))
def pm2(spark, sf):
    return pt.positions(docs(spark, sf), "text", WORDS)


@query("pm3_counts", f"SELECT doc_id, {', '.join(f'CAST({_n('text', S.q(w))} AS INT) AS aca_count_{i}' for i, w in enumerate(WORDS))} FROM documents")
def pm3(spark, sf):
    return pt.counts(docs(spark, sf), "text", WORDS).drop("text")


@query("pm4_frequencies", f"SELECT page_id, {', '.join(f'round({_n('html', S.q(w))} / greatest(length(html), 1), 9) AS aca_freq_{i}' for i, w in enumerate(WORDS))} FROM pages")
def pm4(spark, sf):
    f = pt.frequencies(tb.table(spark, sf, "pages").select("page_id", "html"), "html", WORDS)
    return f.select("page_id", *[F.round(f"aca_freq_{i}", 9).alias(f"aca_freq_{i}") for i in range(len(WORDS))])


@query("pm5_text_totals", f"""WITH t AS (SELECT conv_id, turn, text, [{', '.join(_n('text', S.q(w)) for w in WORDS)}] AS c FROM conversations)
SELECT conv_id, turn, CAST(list_sum(c) AS INT) AS aca_total_matches, CAST(len(list_filter(c, lambda x: x > 0)) AS INT) AS aca_unique_patterns,
  CAST(length(text) AS INT) AS aca_text_length, round(list_sum(c) / greatest(length(text), 1), 9) AS aca_match_density FROM t""")
def pm5(spark, sf):
    c = tb.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return pt.aggregates(c, "text", WORDS).drop("text").withColumn("aca_match_density", F.round("aca_match_density", 9))


@query("pm6_feature_vector", f"""WITH t AS (SELECT doc_id, greatest(length(text), 1) AS len, length(text) AS l0, [{', '.join(_n('text', S.q(w)) for w in WORDS)}] AS c FROM documents)
SELECT doc_id, {3 * len(WORDS) + 4} AS size, CAST(len(list_filter(c, lambda x: x > 0)) AS DOUBLE) AS binary_sum, CAST(list_sum(c) AS DOUBLE) AS count_sum,
  round(list_sum(c) / len, 9) AS density, CAST(l0 AS DOUBLE) AS text_length FROM t""")
def pm6(spark, sf):
    v = pt.feature_vector(docs(spark, sf), "text", WORDS)
    k = len(WORDS)
    total = lambda a, b: F.aggregate(F.slice("aca_features", a, b), F.lit(0.0), lambda x, y: x + y)
    at = lambda i: F.get("aca_features", F.lit(i))
    return v.select("doc_id", F.size("aca_features").alias("size"), total(1, k).alias("binary_sum"), total(k + 1, k).alias("count_sum"),
                    F.round(at(3 * k + 2), 9).alias("density"), at(3 * k + 3).alias("text_length"))


TOKENS = ["flag_syn", "flag_fin", "long_flow", "short_flow", "large_packets", "protocol_17"]
_SCORE = " + ".join(_n("t", S.q(w)) for w in TOKENS)


@query("pm7_pattern_scores", f"""WITH {S.FLOWS}, x AS (SELECT flow_id, {TOKENS_SQL} AS t FROM flows), y AS (SELECT *, {_SCORE} AS s FROM x)
SELECT flow_id, CAST(s AS INT) AS pattern_score, CAST(s > 0 AS INT) AS has_pattern_match, round(s / (SELECT max(s) FROM y), 6) AS detection_score,
  s / (SELECT max(s) FROM y) > 0.7 AS high_pattern, {', '.join(f"CAST(contains(t, {S.q(w)}) AS INT) AS pattern_{w}" for w in TOKENS)} FROM y""")
def pm7(spark, sf):
    f = tb.flows(spark, sf)
    scored = pt.pattern_scores(f.select("flow_id", ft.flow_text(f).alias("tokens")), "tokens", TOKENS)
    return scored.drop("tokens").withColumn("detection_score", F.round("detection_score", 6))


_WORDS = "SELECT pattern FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS pattern FROM benchmark) WHERE length(pattern) >= 2 ORDER BY md5(pattern), pattern LIMIT 500"


@query("pm8_scan_table", f"""WITH w AS ({_WORDS}), c AS (SELECT conv_id, turn, text FROM conversations),
n AS (SELECT conv_id, turn, pattern, len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, length(pattern)) = pattern)) AS n
  FROM c JOIN w ON contains(text, pattern)), t AS (SELECT conv_id, turn, CAST(sum(n) AS BIGINT) AS total_matches, count(*) AS unique_patterns FROM n GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(total_matches, 0) AS total_matches, coalesce(unique_patterns, 0) AS unique_patterns,
  round(coalesce(total_matches, 0) / greatest(length(coalesce(text, '')), 1), 6) AS match_density, CAST(length(coalesce(text, '')) AS INT) AS text_length
FROM c LEFT JOIN t USING (conv_id, turn)""")
def pm8_table(spark, sf):
    """Totals of 500 patterns taken from benchmark words, through the pattern-table form."""
    words = tb.table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("pattern")).distinct().filter(F.length("pattern") >= 2)
    some = words.orderBy(F.md5("pattern"), "pattern").limit(500)
    texts = tb.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return pt.scan_patterns(texts, "text", some, "totals").withColumn("match_density", F.round("match_density", 6))


@query("pm8_gram_join", _positions_sql("documents", "doc_id", "text"))
def pm8(spark, sf):
    from flowlens.functions.lookup import literal_table

    return pt.gram_matches(docs(spark, sf), "text", literal_table(spark, ["pattern"], [(w,) for w in WORDS]))


@query("a35_pattern_statistics", f"""WITH {P}, h AS (SELECT pattern, {_n('text', 'pattern')} AS n FROM documents, p)
SELECT pattern, CAST(sum(n) AS BIGINT) AS total_matches, count(*) FILTER (n > 0) AS texts_hit, round(sum(n) / sum(sum(n)) OVER (), 6) AS share FROM h GROUP BY 1""")
def a35(spark, sf):
    return pt.pattern_statistics(docs(spark, sf), "text", WORDS).withColumn("share", F.round("share", 6))
