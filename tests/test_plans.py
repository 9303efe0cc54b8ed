"""End-to-end plans on the supplied tables."""

import pytest
from pyspark.sql import functions as F

from flowlens.operators import alerts as al, encode as en, verify as vf
from flowlens.operators.alerts import class_name
from flowlens.plans import preprocess as pp
from flowlens.sources import artifacts as ar, sinks, tables as tb
from flowlens.session import new_path
from flowlens.streaming import flows as sf_


@pytest.fixture(scope="module")
def raw(spark, sf):
    flows = tb.flows(spark, sf).drop("pred_aca_svm", "pred_fuzzy_rf", "pred_intrudtree")
    named = flows.withColumn("Attack", class_name(F.col("label_idx"))).drop("label_idx")
    return named.withColumn("sample", F.md5(F.col("src_ip"))).withColumn("note", F.concat(F.lit("n"), F.col("dst_port").cast("string")))


def test_preprocess_scales_and_encodes(raw, spark):
    cfg = pp.PreprocessConfig(fit_on="all", resample=False)
    out = pp.preprocess(raw, cfg)
    assert "sample_encoded" in out.features and "note_encoded" not in out.data.columns
    assert {"flow_duration_log", "flag_entropy", "protocol_encoded", "port_diff"} <= set(out.features)
    lo, hi = out.data.agg(F.least(*[F.min(c) for c in out.features]), F.greatest(*[F.max(c) for c in out.features])).first()
    assert lo == 0 and hi == pytest.approx(1)
    assert out.data.count() == raw.distinct().count()
    path = new_path(spark, "saved")
    pp.save(out, path, cfg, ["a", "b"])
    assert ar.load_stats(spark, f"{path}/stats")["scaler"].keys() == out.stats["scaler"].keys()
    test = sinks.read_processed(spark, f"{path}/data", "test")
    assert test.count() == out.data.filter("split = 'test'").count()


def test_scaler_fits_on_train_only(raw):
    out = pp.preprocess(raw, pp.PreprocessConfig(scaler="standard", resample=False))
    train = out.data.filter("split = 'train'").agg(F.avg("flow_duration"), F.stddev_pop("flow_duration")).first()
    assert train[0] == pytest.approx(0, abs=1e-9) and train[1] == pytest.approx(1)


def test_preprocess_sample_and_resample(raw):
    out = pp.preprocess(raw, pp.PreprocessConfig(sample_size=2000, resample=True))
    counts = {r["label_idx"]: r["count"] for r in out.data.filter("split = 'train'").groupBy("label_idx").count().collect()}
    assert min(counts.values()) >= 100


def test_categorical_limit(spark):
    rows = [(f"v{i % 100}", f"w{i % 130}", "x" * 21 + str(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    plan = en.plan_categoricals(df, ["a", "b", "c"])
    assert plan.encode == ("a", "c") and plan.drop == ("b",)


def test_alert_record_schema(spark, sf):
    r = al.alert_records(tb.alerts(spark, sf)).first()
    assert set(r["model_predictions"]) == {"ACA_SVM", "Fuzzy_RF", "IntruDTree"}
    assert r["model_predictions"]["ACA_SVM"]["is_correct"] in (True, False) and r["key_features"] == {}


def test_key_features_top_up(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "flow_duration double, other double, more double")
    got = df.select(al.key_features(df)).first()[0]
    assert got == {"Flow Duration": 1.0, "other": 2.0, "more": 3.0}


def test_key_feature_texts(spark):
    df = spark.createDataFrame([(1.5, "tcp", "7", None)], "flow_duration double, proto string, code string, empty string")
    assert df.select(al.key_features(df)).first()[0] == {"Flow Duration": 1.5}
    assert df.select(al.key_feature_texts(df)).first()[0] == {"proto": "tcp", "code": "7"}


def test_export_is_typed_by_name(spark, tmp_path):
    """Headers in any order, numbers with spaces or fractions, text that is no number, columns beyond the schema."""
    from flowlens import fixed_values as fv
    from flowlens.sources import readers, schema as sch

    heads = ["Label", "Custom", *reversed(fv.EXPORT_FEATURES), "Src IP"]
    row = ["Benign", "x", *["6.0" if h == "Protocol" else "oops" if h == "Flow Duration" else "2.5" if h == "SYN Flag Count" else " 3 " for h in reversed(fv.EXPORT_FEATURES)], "1.2.3.4"]
    path = tmp_path / "e.csv"
    path.write_text(",".join(heads) + "\n" + ",".join(row) + "\n")
    got = readers.read_export(spark, str(path))
    kinds, r = dict(got.dtypes), got.first()
    names = [sch.feature_column(h) for h in fv.EXPORT_FEATURES]
    assert len(set(names)) == 77 and all(kinds[n] in ("double", "int", "bigint") for n in names)
    assert r["protocol"] == 6 and r["flow_duration"] is None and r["syn_flag_count"] is None and r["idle_min"] == 3.0
    assert r["custom"] == "x" and r["label"] == "Benign" and r["src_ip"] == "1.2.3.4"


def test_codes_of_many_columns_equal_their_own(spark, monkeypatch):
    """One dictionary pass gives each column the codes it gets alone, broadcast or joined."""
    from flowlens.operators import encode as en

    df = spark.createDataFrame([(k, (k * 7) % 13 if k % 9 else None, f"v{k % 5}" if k % 4 else None, f"0:{k % 3}") for k in range(60)],
                               "id int, num int, text string, odd string")
    codings = [en.Coding("num", "a"), en.Coding("text", "b", None, en.NA), en.Coding("odd", "c"), en.label_coding("text", "d")]
    want = df
    for c in codings:
        want = en.encode_column(want, c.column, c.out, c.null_code, c.null_value)
    want = sorted(map(tuple, want.collect()))
    for most in (en.BROADCAST_ENTRIES, 6, 0):
        assert sorted(map(tuple, en.encode_columns(df, codings, most).collect())) == want
    assert en.encode_columns(df.limit(0), codings).count() == 0


def test_upserts_survive_replay(spark, sf):
    """A second run from the same checkpoint adds nothing."""
    events = tb.alerts(spark, sf)
    feed, out, cp = new_path(spark, "feed"), new_path(spark, "up"), new_path(spark, "cp")
    events.repartition(3).write.parquet(feed)

    def totals():
        stream = al.enrich(sf_.event_time(sf_.source(spark, feed, events.schema, 1), delay="400 days"))
        sf_.run_upserts(sf_.detection_time_totals(stream, ["attack_type"]), out, cp, ["attack_type"])
        return {r["attack_type"]: r["n"] for r in sf_.latest_upserts(spark, out, ["attack_type"]).collect()}

    first = totals()
    batch = {r["attack_type"]: r["n"] for r in vf.counted_detections(al.enrich(events)).groupBy("attack_type").agg(
        F.count("*").alias("n")).collect()}
    assert first == batch == totals()


def test_raw_headers_reach_the_derived_features(spark, tmp_path):
    from flowlens.plans import preprocess as pp

    head = ["Src IP", "Dst IP", "Src Port", "Dst Port", "Protocol", "Timestamp", "Flow Duration", "Total Fwd Packet", "Total Bwd packets",
            "Flow Bytes/s", "Flow Packets/s", "Packet Length Mean", "Flow IAT Mean", "Fwd IAT Mean", "Bwd IAT Mean", "FIN Flag Count",
            "SYN Flag Count", "RST Flag Count", "PSH Flag Count", "ACK Flag Count", "URG Flag Count", "Label"]
    lines = [",".join(head)]
    for k in range(400):
        rate = "Infinity" if k % 50 == 7 else "NaN" if k % 50 == 8 else str(k * 3.5)
        lines.append(f"10.0.0.{k % 9},10.0.1.{k % 7},{k},{k % 1100},6,12/05/2022 0{1 + k % 9}:1{k % 5}:00 AM,{k * 7},{k % 5},{k % 3},{rate},{k},"
                     f"{k % 90},1.5,2.5,3.5,{k % 2},1,0,0,{k % 3},0,{'Benign' if k % 8 == 0 else 'Worm'}")
    path = tmp_path / "flows.csv"
    path.write_text("\n".join(lines) + "\n")
    raw = spark.read.option("header", True).option("inferSchema", True).csv(str(path))
    result = pp.preprocess(raw)
    assert {"flow_duration_log", "total_flags", "iat_mean", "port_diff", "packet_size_ratio", "bytes_per_sec_log"} <= set(result.features)
    n = {(r["split"], r["label"]): r["n"] for r in result.data.groupBy("split", "label").agg(F.count("*").alias("n")).collect()}
    assert n["test", "Benign"] == 15 and n["test", "Worm"] == 105
    assert n["train", "Worm"] == 245 and n["train", "Benign"] == 100  # ratio 7: drawn up to the minority target
    assert dict(result.data.dtypes)["ts"] == "timestamp_ntz" and result.data.filter("ts is null").count() == 0


def test_tree_variants_stay_different():
    from flowlens.operators import models as md

    found = md.effective_variants(md.TREE_VARIANTS, 10, 30)
    assert len(set(found)) == len(found) and max(d for d, _, _ in found) == 30 and max(n for _, _, n in found) == 10
