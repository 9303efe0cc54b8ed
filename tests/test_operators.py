"""Behaviour of operators on small frames."""

import pytest
from pyspark.sql import functions as F

from flowlens import fixed_values as fv
from flowlens.operators import (
    alerts as al, balance as bl, clean as cl, compare as cp, fuzzy as fz, models as md, reports as rp, sampling as sp,
    scaling as sc, selection as fs, severity as sv, verify as vf,
)
from flowlens.sources import readers, tables as tb
from flowlens.session import new_path


def first(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


# --- sampling --------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, -3, 1, 37, 5000, 99999])
def test_exact_sample_size(spark, n):
    df = spark.range(5000)
    got = [r["id"] for r in sp.sample_exact(df, "id", n).collect()]
    assert len(got) == len(set(got)) == max(0, min(n, 5000))


def test_sample_equals_bottom_k(spark):
    df = spark.range(3000)
    a = {r["id"] for r in sp.sample_exact(df, "id", 250).collect()}
    assert a == {r["id"] for r in sp.bottom_k(df, "id", 250).collect()}


def test_sample_ignores_partitioning(spark):
    df = spark.range(2000)
    a = {r["id"] for r in sp.sample_exact(df.repartition(13), "id", 100).collect()}
    assert a == {r["id"] for r in sp.sample_exact(df.coalesce(1), "id", 100).collect()}


def test_split_quota_per_class(spark):
    df = spark.range(1000).withColumn("c", (F.col("id") % 10 == 0).cast("int"))
    got = {(r["c"], r["split"]): r["count"] for r in sp.split_exact(df, "id", "c").groupBy("c", "split").count().collect()}
    assert got == {(0, "test"): 270, (0, "train"): 630, (1, "test"): 30, (1, "train"): 70}


def test_numbering_is_dense_for_a_hot_group(spark):
    df = spark.range(4000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold"))
    rows = sp.numbered(df, "id", "g").groupBy("g").agg(F.collect_set("row_idx").alias("s"), F.first("group_size").alias("n")).collect()
    assert all(sorted(r["s"]) == list(range(r["n"])) for r in rows)


def test_resample_reaches_targets(spark):
    df = spark.range(2100).withColumn("c", F.when(F.col("id") < 2000, 0).otherwise(1))
    got = {r["c"]: r["count"] for r in bl.expand(bl.resample(df, "id", "c", "minority")).groupBy("c").count().collect()}
    assert got == {0: 2000, 1: 400}
    poisson = {r["c"]: r["n"] for r in bl.resample_poisson(df, "id", "c", "minority").groupBy("c").agg(F.sum("copies").alias("n")).collect()}
    assert poisson[0] == 2000 and abs(poisson[1] - 400) < 80


@pytest.mark.parametrize("counts,policy,expected", [
    ({0: 1000, 1: 50}, "tiered", 75), ({0: 600, 1: 100}, "tiered", 120), ({0: 300, 1: 100}, "tiered", 200),
    ({0: 150, 1: 100}, "tiered", None), ({0: 100, 1: 95}, "median", None), ({0: 100, 1: 50, 2: 60}, "median", 60)])
def test_targets(spark, counts, policy, expected):
    df = spark.createDataFrame([(c,) for c, n in counts.items() for _ in range(n)], "c int")
    assert {r["target"] for r in bl.targets(df, "c", policy).collect()} == {expected}


# --- scores and votes ------------------------------------------------------------
def probs(*p):
    return F.array(*[F.lit(float(x)) for x in p])


@pytest.mark.parametrize("p,pred,fuzzy,expected", [
    ((.1, .6, .3), 1, 0, 2), ((.05, .65, .05, .25), 1, 0, 3), ((.02, .69, .01), 1, 0.9, 1),
    ((.1, .8, .1), 1, .31, 0), ((.1, .8, .1), 1, .3, 1), ((.5, .3, .2), 0, 1, 0)])
def test_override(spark, p, pred, fuzzy, expected):
    got = first(spark, x=fz.override_prediction(probs(*p), F.lit(pred), F.lit(float(fuzzy)), 1))
    assert got["x"] == expected


def test_vote_ties_go_to_lowest_class(spark):
    v = lambda *xs: [F.lit(x) for x in xs]
    r = first(spark, a=md.vote(v(3, 2, 1)), b=md.vote(v(2, 2, 1)), c=md.vote(v(5, 4, 5, 4)),
              w=md.weighted_vote(dict(zip("xyz", v(1, 2, 2))), {"x": .5, "y": .2, "z": .2}),
              z=md.weighted_vote(dict(zip("xy", v(7, 3))), {"x": 0, "y": 0}))
    assert r == {"a": 1, "b": 2, "c": 4, "w": 1, "z": 3}


def test_severity_rules(spark):
    f = lambda label, n: al.adjusted_severity(F.lit(label), F.lit(n))
    r = first(spark, a=f("Worm", 0), b=f("Worm", 1), c=f("Hoax", 3), d=f("Hoax", 0), e=f("Benign", 3), g=f("Other", 1))
    assert list(r.values()) == ["Medium", "High", "High", "Low", "Low", "Medium"]


def test_behavior_score_counts_false_indicators(spark):
    r = first(spark, s=sv.behavior_score({"high_byte_rate": F.lit(True), "high_packet_rate": F.lit(False)}),
              n=sv.behavior_score({"high_byte_rate": F.lit(None).cast("boolean")}))
    assert r["s"] == pytest.approx(.25 * .9 / .55) and r["n"] == 0


def test_risk_score_and_levels(spark):
    s = sv.risk_score(F.lit("High"), F.lit("Ransomware"), F.lit(True), F.lit(True), F.lit("ICMP"))
    r = first(spark, s=s, lv=sv.risk_level(s), low=sv.risk_level(F.lit(.39)))
    assert r["s"] == pytest.approx(.32 + .2375 + .2 + .12) and r["lv"] == "Critical" and r["low"] == "Low"


def test_actions_are_extended_once(spark):
    df = spark.createDataFrame([("High", "Trojan"), ("High", "Worm"), ("?", "x")], "lv string, a string")
    rows = {r["a"]: r for r in sv.with_actions(df, "lv", "a").collect()}
    assert rows["Trojan"]["immediate"] == fv.ACTIONS["High"]["immediate"] + fv.ATTACK_IMMEDIATE_ACTIONS["trojan"]
    assert rows["Worm"]["immediate"] == fv.ACTIONS["High"]["immediate"] and rows["x"]["priority"] == "Low"


def test_short_numbers(spark):
    r = first(spark, a=al.short_number(F.lit(1_500_000.0)), b=al.short_number(F.lit(34_000.0)), c=al.short_number(F.lit(5.6)))
    assert list(r.values()) == ["1.5M", "34K", "5.6"]


def test_strengths(spark):
    long = spark.createDataFrame([("a", "m", 90.0), ("b", "m", 60.0), ("c", "m", 75.0)], "model string, metric string, value double")
    assert {(r["model"], r["note"]) for r in cp.strengths(long).collect()} == {("a", "High m"), ("b", "Low m")}


def test_kappa_bands(spark):
    def reliability(confirmed, total):
        rows = [(f"f{i}", i < confirmed, 1) for i in range(total)]
        return vf.reliability(spark.createDataFrame(rows, "flow_id string, is_threat boolean, ensemble int")).first()

    top, low = reliability(10, 10), reliability(1, 10)
    assert top["kappa_adjusted"] == pytest.approx(1) and top["kappa_band"] == "Excellent" and top["reliability_level"] == "high"
    assert low["kappa_band"] == "No Agreement" and low["reliability_score"] == pytest.approx(10 * .6 + 10 * .4)


def test_withdrawn_verdicts(spark):
    ev = spark.createDataFrame(
        [("a", 1, True, 5.0), ("a", 2, None, 6.0), ("b", 1, None, 7.0), ("b", 3, False, 8.0)],
        "flow_id string, verified_at int, is_threat boolean, analysis_time double")
    assert [tuple(r) for r in vf.active(ev).select("flow_id", "is_threat", "analysis_time").collect()] == [("b", False, 8.0)]


def test_analysis_time_bounds(spark):
    df = spark.createDataFrame([("2",), ("300",), ("1.9",), ("301",), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(vf.valid_analysis_time(F.col("t"))).collect()] == [2.0, 300.0, None, None, None, None]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double")
    for method in ("minmax", "standard"):
        assert [r["x"] for r in sc.scale(df, ["x"], sc.lazy_scaler(df, ["x"]), method).collect()] == [0.0, 0.0, None]


def test_quality_profile_counts(spark):
    df = spark.createDataFrame([(float("inf"), None, 0), (1.0, "a", 0), (None, "b", 1)], "x double, s string, y int")
    got = {(r["section"], r["item"]): r["value"] for r in cl.quality_profile(df, "y").collect()}
    assert got["infinite", "total"] == 1 and got["missing", "x"] == 1 and got["missing", "s"] == 1
    assert got["imbalance", "ratio"] == 2 and got["class", "0"] == 2


def test_quota_selection_keeps_other_order(spark):
    rows = [("flow_duration", .9), ("fin_flag_count", .8), ("syn_flag_count", .7), ("other_a", .6), ("other_b", .1)]
    df = spark.createDataFrame(rows, "feature string, s double")
    got = {r["feature"] for r in fs.quota_selection(df, "s", 4).collect()}
    assert got == {"flow_duration", "fin_flag_count", "syn_flag_count", "other_a"}


def test_running_mean_over_buckets(spark):
    rows = [("k", f"2024-01-0{1 + i // 5} 0{i % 5}:00:00", f"f{i}", float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "key string, ts string, flow_id string, detection_time double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["flow_id"]: r["running_mean"] for r in rp.running_detection_time(df, "key").collect()}
    assert got == pytest.approx({f"f{i}": i / 2 for i in range(20)})


def test_bad_json_lines_are_kept_apart(spark):
    path = new_path(spark, "bad-json")
    spark.createDataFrame([('{"flow_id": "a", "prediction": 2}',), ("{oops",)], "value string").write.text(path)
    raw = readers.read_json_lines(spark, path, readers.DETECTION_SCHEMA)
    assert raw.filter(F.col(readers.CORRUPT).isNotNull()).count() == 1
    assert [r["flow_id"] for r in readers.read_detection_log(spark, path).collect()] == ["a"]


def test_signature_file_categories(spark):
    path = new_path(spark, "signatures-test")
    spark.createDataFrame([("# Head\n\n  one \n#second group\ntwo\n\n",)], "value string").write.text(path)
    got = {(r["pattern"], r["category"]) for r in readers.read_signatures(spark, path).collect()}
    assert got == {("one", "Head"), ("two", "second group")}


# --- plans stay scalable ------------------------------------------------------------
def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_plan_prunes_and_combines(spark, sf):
    plan = plan_of(rp.attack_frequency(al.enrich(tb.flows(spark, sf))))
    scan = plan[plan.index("FileScan"):]
    assert "l_shipdate" not in scan.split("ReadSchema")[1].split("\n")[0]
    assert "partial_count" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["e01_duration_features", "f01_sigma_rules", "a07_confusion", "a20_risk_report", "p06_valid_alerts"])
def test_no_nested_loops_or_python(spark, sf, name):
    import __spark_entry__ as entry

    plan = plan_of(entry.queries()[name](spark, sf))
    assert not any(w in plan for w in ("CartesianProduct", "NestedLoop", "Python", "ArrowEval"))


def test_equal_times_go_by_arrival(spark):
    from flowlens.operators import verify as vf

    rows = [("f", 1, 1, True), ("f", 1, 3, False), ("f", 1, 2, True), ("g", 1, 1, True), ("g", 1, 2, None)]
    df = spark.createDataFrame(rows, "flow_id string, verified_at int, event_id int, is_threat boolean")
    assert [(r["flow_id"], r["is_threat"]) for r in vf.active(df).collect()] == [("f", False)]


def test_poisson_draws_of_a_large_rate_keep_their_variance(spark):
    df = spark.range(400).selectExpr("id", "'a' as c").unionByName(spark.range(400, 402).selectExpr("id", "'b' as c"))
    original = bl.TARGETS["minority"]
    bl.TARGETS["minority"] = lambda: F.when(F.col("n") == 400, F.lit(400 * 900))
    try:
        copies = [r["copies"] for r in bl.resample_poisson(df, "id", "c", "minority").filter("c = 'a'").collect()]
    finally:
        bl.TARGETS["minority"] = original
    mean = sum(copies) / 400
    variance = sum((x - mean) ** 2 for x in copies) / 399
    assert abs(mean - 900) < 6 and 650 < variance < 1200


def test_running_means_of_a_hot_second(spark):
    """One key with 90 % of the rows in one second: equal to a plain running mean, and no range holds twice its share."""
    rows = [("hot" if k % 10 else f"k{k % 7}", 1_000 if k % 10 else k, f"f{k:04d}", None if k % 17 == 0 else float(k % 13)) for k in range(4000)]
    df = spark.createDataFrame(rows, "k string, s long, flow_id string, detection_time double").select(
        "k", F.timestamp_seconds("s").alias("ts"), "flow_id", "detection_time")
    want, sums = {}, {}
    for k, s, f, d in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        total, n = sums.get(k, (0.0, 0))
        sums[k] = total, n = total + (d or 0.0), n + (d is not None)
        want[f] = total / n if n else None
    got = {r["flow_id"]: r["running_mean"] for r in rp.running_detection_time(df, "k").collect()}
    assert got.keys() == want.keys() and all(got[f] == pytest.approx(want[f]) for f in want)
    ranged = df.repartitionByRange("k", "ts", "flow_id").groupBy(F.spark_partition_id()).count()
    sizes = [r["count"] for r in ranged.collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)
    null = spark.createDataFrame([(None, None, "a", 1.0), (None, None, "a", 3.0)], "k string, ts timestamp, flow_id string, detection_time double")
    assert sorted(r["running_mean"] for r in rp.running_detection_time(null, "k").collect()) in ([1.0, 2.0], [2.0, 3.0])


def test_sample_of_one_repeated_key_is_exact_and_stable(spark):
    from flowlens.operators import sampling as sp

    df = spark.range(1000).selectExpr("case when id % 10 = 0 then id else -1 end as k", "id")
    a = {r["id"] for r in sp.sample_exact(df, "k", 300).collect()}
    assert len(a) == 300 and a == {r["id"] for r in sp.sample_exact(df.repartition(7), "k", 300).collect()}
