"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_discriminant")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Distinct shingles of every document, shared shingles by document pair, transitive closure of the links.
OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b
  WHERE 100 * k >= 80 * (u.n_shingles + v.n_shingles - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
d AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM n JOIN c USING (doc_id) LEFT JOIN d USING (doc_id)
"""


@query("op2_ngram_jaccard_join", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import jaccard

    return jaccard.join(table(spark, sf_dir, "documents"))


@query("op3_pii_boosting")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import pii

    return pii.digest(table(spark, sf_dir, "documents"))


@query("op4_benchmark_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import decontaminate

    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_pareto_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import mixing

    return mixing.summary(table(spark, sf_dir, "documents"))


@query("op6_toxicity_ftrl")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import toxicity

    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_string_kernel_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import langid

    return langid.classify(table(spark, sf_dir, "documents"))


@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from flowlens.llm import tokenfile

    index = tokenfile.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.read(index)


#: floor(64 x component) as integers, their inner products, 20 best of each query.
OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op9_exact_topk", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import topk

    return topk.search(table(spark, sf_dir, "embeddings"))


@query("op10_histogram_sort_shards")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import sharding

    return sharding.assign(table(spark, sf_dir, "documents"))


#: Pieces, words, all phrases of up to three words; whole-number scores of both cuts; phrases held by a longer one.
OP11_SQL = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM w WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM w WHERE len(w) > 2),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING k = 1 OR count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (
  SELECT c.*, cut, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score
  FROM (SELECT c.*, unnest(range(1, k)) AS cut FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
h AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
r AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN h USING (lang, phrase) WHERE h.a IS NULL OR 100 * h.a < 50 * b.a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM r JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op11_phrase_graph", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import collocations

    return collocations.mine(table(spark, sf_dir, "documents")).drop("path_words")


#: Failure bits of every document, all orders of the five letters, counts by bits.
OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
b AS (
  SELECT part, (len(w) < 50)::INTEGER + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INTEGER
    + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t))::INTEGER + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INTEGER AS bits,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic
  FROM w),
g AS (SELECT part, bits, good, toxic, count(*) AS n FROM b GROUP BY ALL),
l AS (SELECT f::INTEGER AS f, 'ABCDE'[f + 1] AS c FROM range(5) t(f)),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.f, b.f, c.f, d.f, e.f] AS fs
  FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (
  SELECT filter_order, k::INTEGER AS step, (1 << fs[k])::INTEGER AS own,
    coalesce(list_sum(list_transform(fs[1:k - 1], lambda f: 1 << f)), 0)::INTEGER AS before FROM o, range(1, 6) t(k)),
r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE bits & (before | own) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE bits & own > 0 AND bits & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE bits & own > 0 AND bits & before > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE bits = own), 0) AS unique_fails,
    coalesce(sum(n) FILTER (WHERE good AND bits & own > 0 AND bits & before = 0), 0) AS good_lost,
    coalesce(sum(n) FILTER (WHERE toxic AND bits & own > 0 AND bits & before = 0), 0) AS toxic_lost
  FROM g CROSS JOIN s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""


@query("op12_filter_audit", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import audit

    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_site_templates")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import pages

    return pages.extract(table(spark, sf_dir, "pages"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
