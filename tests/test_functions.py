"""Hand-computed values of column functions and small-fixture brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions import keys, membership as mb, numeric as nm, text as tx
from flowlens.functions.lookup import literal_table, lookup
from flowlens.functions.quantile import exact_quantiles
from flowlens.operators import encode as en, patterns as pt
from flowlens.sources import schema as sch


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def test_membership_degrees(spark):
    x = lambda v: F.lit(float(v))
    r = one(spark, low=mb.low(x(5), 10), med=mb.medium(x(15), 10), high=mb.high(x(15), 10), top=mb.very_high(x(25), 10),
            cap=mb.high(x(99), 10), rate=mb.degrees("bytes_per_second", x(1500))["high"],
            log=mb.degrees("other", x(math.e - 1))["high"], neg=mb.degrees("other", x(-1))["high"])
    assert r == pytest.approx({"low": .5, "med": .5, "high": .5, "top": .5, "cap": 1, "rate": .5, "log": .1, "neg": 0})


def test_row_statistics_skip_nulls(spark):
    cols = [F.lit(1.0), F.lit(None).cast("double"), F.lit(3.0)]
    r = one(spark, s=nm.row_sum(cols), m=nm.row_mean(cols), d=nm.row_std_samp(cols), e=nm.shannon_shares([F.lit(1), F.lit(1)]))
    assert r["s"] == 4 and r["m"] == 2 and r["d"] == pytest.approx(math.sqrt(2)) and r["e"] == pytest.approx(1, abs=1e-6)


def test_non_finite_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(nm.finite_or_null(F.col("x"))).collect()] == [None, None, None, 2.0, None]


def test_lookup_default(spark):
    assert one(spark, a=lookup({"x": 1.5}, F.lit("x"), 0.0), b=lookup({"x": 1.5}, F.lit("y"), 0.5)) == {"a": 1.5, "b": .5}


def test_hash_is_uniform(spark):
    u = spark.range(20000).select(keys.hash_uniform(keys.key_hash(F.col("id"), 1)).alias("u"))
    r = u.agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(r[0] - .5) < .01 and 0 <= r[1] and r[2] < 1


@pytest.mark.parametrize("name,expected", [
    ("Flow Bytes/s", "flow_bytes_per_s"), ("Src IP", "src_ip"), ("Total Fwd Packet", "total_fwd_packet"),
    ("Down/Up Ratio", "down_up_ratio"), ("FIN Flag Count", "fin_flag_count")])
def test_canonical_names(name, expected):
    assert sch.canonical_name(name) == expected


def brute(text, patterns):
    return sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))


TEXTS = ["", "aba", "ababababa", "naïve aba\naba é", "x" * 300 + "aba" + "y" * 200 + "abab", "aaaa", "tail ab"]
PATTERNS = ["aba", "aa", "é", "ab", "y\\E.x", "xaba"]


def test_positions_and_grams_match_brute_force(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abxé\n") for _ in range(rng.randint(0, 700))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = sorted((i, s, p) for i, t in enumerate(texts) for s, p in brute(t, PATTERNS))
    got = pt.positions(df, "text", PATTERNS)
    assert sorted((r["id"], r["start"], r["pattern"]) for r in got.collect()) == want
    assert all(r["end"] == r["start"] + len(r["pattern"]) - 1 for r in got.collect())
    table = literal_table(spark, ["pattern"], [(p,) for p in PATTERNS])
    grams = pt.gram_matches(df, "text", table)
    assert sorted((r["id"], r["start"], r["pattern"]) for r in grams.collect()) == want
    counted = pt.counts(df, "text", PATTERNS).orderBy("id").collect()
    for row in counted:
        assert [row[f"aca_count_{k}"] for k in range(len(PATTERNS))] == [
            sum(1 for _, q in brute(texts[row["id"]], [p])) for p in PATTERNS]


def test_positions_across_slices(spark):
    text = "q" * 4094 + "needle" + "q" * 4090 + "needle"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert sorted(r["start"] for r in pt.positions(df, "text", ["needle"]).collect()) == [4094, 4094 + 6 + 4090]


def test_overlap_detection():
    assert tx.overlaps_itself("aba") and tx.overlaps_itself("aa") and not tx.overlaps_itself("abc")


def test_feature_vector_invariants(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    words = ["the", "aa", "que"]
    names = pt.feature_names(3)
    for r in pt.feature_vector(df, "text", words).select("aca_features", F.length("text").alias("n")).collect():
        v = r["aca_features"]
        assert len(v) == len(names) == 13
        assert set(v[:3]) <= {0.0, 1.0} and all(c >= 0 for c in v[3:6])
        assert v[6:9] == pytest.approx([c / max(r["n"], 1) for c in v[3:6]]) and v[9] == sum(v[3:6])


def test_signature_sentences(spark):
    """Presence in sentences that mention attacks, by the built-in list."""
    from flowlens import fixed_values as fv

    df = spark.createDataFrame([(1, "possible sql_injection and worm"), (2, "plain text")], "id int, text string")
    got = {(r["id"], r["pattern"]) for r in pt.matching_patterns(df, "text", fv.MALWARE_SIGNATURES).collect()}
    assert got == {(1, "sql_injection"), (1, "worm")}


@pytest.mark.parametrize("small", [5, 50, 10_000])
def test_exact_quantiles(spark, small):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1e3, 3000), rng.integers(0, 4, 3000).astype(float)
    df = spark.createDataFrame([(float(x), float(y) if y else None) for x, y in zip(a, b)], "a double, b double")
    got = exact_quantiles(df, {"a": [.1, .5, .95], "b": [.5, .8]}, small=small, buckets=7)
    for p in (.1, .5, .95):
        assert got["a", p] == pytest.approx(np.quantile(a, p))
    for p in (.5, .8):
        assert got["b", p] == pytest.approx(np.quantile(b[b > 0], p))


@pytest.mark.parametrize("least,most", [(4, 200_000), (20, 200_000), (10_000, 200_000), (10_000, 1)])
def test_quantiles_from_brackets_and_from_buckets(spark, monkeypatch, least, most):
    """Coarse sketches, fine ones and none at all give the same exact values, ties included."""
    from flowlens.functions import quantile

    monkeypatch.setattr(quantile, "LEAST_ACCURACY", least)
    monkeypatch.setattr(quantile, "MOST_ACCURACY", most)
    monkeypatch.setattr(quantile, "INSIDE", 10**9)
    rng = np.random.default_rng(4)
    columns = {"smooth": rng.normal(size=3000), "ties": rng.integers(0, 4, 3000).astype(float), "tail": rng.pareto(0.5, 3000), "one": np.full(3000, 2.5)}
    rows = [tuple(float(v[k]) if k % 97 or c != "smooth" else None for c, v in columns.items()) for k in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    wanted = {c: [0.0, 0.01, 0.25, 0.5, 0.505, 0.9, 1.0] for c in columns}
    got = quantile.exact_quantiles(df, wanted, small=50, buckets=16)
    for c, v in columns.items():
        own = v[np.arange(3000) % 97 > 0] if c == "smooth" else v
        for p in wanted[c]:
            assert got[c, p] == pytest.approx(np.quantile(own, p), rel=1e-12, abs=1e-12), (c, p)


def test_exact_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "a double")
    assert exact_quantiles(df, {"a": [.5]}) == {("a", .5): None}


@pytest.mark.parametrize("small", [True, False])
def test_dense_codes(spark, small):
    values = random.Random(2).sample(range(100_000), 3000)
    df = spark.createDataFrame([(v,) for v in values], "value int")
    got = {r["value"]: r["code"] for r in en.dense_codes(df, small=small).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}


def test_missing_category_codes(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "c string")
    assert [r["k"] for r in en.encode_column(df, "c", "k").orderBy("c").collect()] == [-1, 0, 1]
    assert {r["c"]: r["k"] for r in en.encode_labels(df, "c", "k").collect()} == {None: 0, "a": 1, "b": 2}


@pytest.mark.parametrize("n", [9_999, 20_001])
def test_quantiles_leave_out_what_is_not_finite(spark, n):
    odd = "case when id % 100 = 1 then double('Infinity') when id % 100 = 2 then double('-Infinity') when id % 100 = 3 then double('NaN') when id % 100 = 4 then null else double(id) end"
    df = spark.range(n).selectExpr(f"{odd} as x", "case when id % 2 = 0 then 1.7e308 else -1.7e308 end as wide", "double('Infinity') as never")
    got = exact_quantiles(df, {"x": [0.0, 0.5, 0.9], "wide": [0.25, 0.75], "never": [0.5]})
    values = sorted(k for k in range(n) if k % 100 not in (1, 2, 3, 4))
    for p in (0.0, 0.5, 0.9):
        r = p * (len(values) - 1)
        lo, hi = values[int(r)], values[min(int(r) + 1, len(values) - 1)]
        assert got["x", p] == pytest.approx(lo + (hi - lo) * (r - int(r)))
    assert (got["wide", 0.25], got["wide", 0.75], got["never", 0.5]) == (-1.7e308, 1.7e308, None)


def test_scaler_medians_are_exact(spark):
    from flowlens.operators import scaling as sc

    df = spark.range(15_001).selectExpr("double(id * id) as x", "case when id % 3 = 0 then null else double(id) end as y")
    stats = sc.fit_scaler(df, ["x", "y"], impute=True)
    assert stats["x__median"] == 7_500.0**2 and stats["y__median"] == 7500.0
    row = sc.scale(df.limit(1), ["x"], sc.lazy_scaler(df, ["x"], impute=True), "standard", impute=True).first()
    assert row["x"] is not None


@pytest.mark.parametrize("mode", ["position", "count", "presence", "frequency", "totals"])
def test_pattern_tables_scan_alike_on_both_routes(spark, mode, monkeypatch):
    texts = [(0, "the abab of ABABAB"), (1, ""), (2, None), (3, "a" * 70 + "bab"), (4, "nothing")]
    df = spark.createDataFrame(texts, "id int, text string")
    table = spark.createDataFrame([("aba",), ("ab",), ("",), (None,), ("the abab of abab",), ("a",)], "pattern string")
    wide = sorted(map(tuple, pt.scan_patterns(df, "text", table, mode, lower=True).collect()))
    monkeypatch.setattr(pt, "WIDE_LIMIT", 1)
    assert sorted(map(tuple, pt.scan_patterns(df, "text", table, mode, lower=True).collect())) == wide and wide
    none = pt.scan_patterns(df, "text", table.limit(0), mode)
    assert none.count() == (5 if mode == "totals" else 0)


def test_cluster_needs_a_shared_folder(monkeypatch):
    from flowlens import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
