"""Learned operators: held-out accuracy on the supplied tables, folds, and the awkward table."""

import zlib

import helpers as h
import numpy as np
import pyarrow as pa
import pytest

from flowlens.llm import common, langid, quality, toxicity

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def data(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


def held_out(rows, truth, label):
    pairs = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    return pairs


def test_quality_on_the_held_out_fold(data):
    rows = quality.classify(*data).collect()
    truth = {r["doc_id"]: r["quality"] for r in data[1].collect()}
    pairs = held_out(rows, truth, "quality")
    assert len(pairs) > 80 and np.mean([a == b for a, b in pairs]) > 0.95
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_toxicity_on_the_held_out_fold(data):
    rows = toxicity.classify(*data).collect()
    truth = {r["doc_id"]: r["toxic"] for r in data[1].collect()}
    pairs = held_out(rows, truth, "toxic")
    assert sum(a and b for a, b in pairs) >= 8 and sum(a and not b for a, b in pairs) == 0
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_language_on_the_held_out_fold(data):
    rows = langid.classify(data[0]).collect()
    truth = {r["doc_id"]: r["lang"] for r in data[0].collect()}
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(held) > 150 and np.mean(held) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("operator, label", [(quality.classify, "quality"), (toxicity.classify, "toxic")])
def test_classifiers_on_awkward_rows(spark, operator, label):
    docs = h.table(spark)
    rows = operator(docs, h.labels(spark, label)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows) == sorted((r[0] is not None, r[0] or 0) for r in h.rows())
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 0}) == 1
    none = operator(docs, h.labels(spark, label).limit(0)).collect()
    assert len({r["score"] for r in none}) == 1
    one = operator(docs, spark.createDataFrame([(k, 1) for k in range(0, 63, 3)], f"doc_id long, {label} int")).collect()
    assert all(r["predicted"] == 1 for r in one)
    assert operator(h.empty(spark), h.labels(spark, label)).count() == 0


def test_language_on_awkward_rows(spark):
    rows = langid.classify(h.table(spark)).collect()
    assert len(rows) == len(h.rows())
    by_text = {r["doc_id"]: r for r in rows}
    for k, text in enumerate(h.TEXTS):
        letters = any(c.isalpha() for c in text or "")
        assert (by_text[k * 3]["lang_pred"] == "und") == (not letters), text
        assert by_text[k * 3]["lang_pred"] in {"aa", "bb", "und"}
    assert langid.classify(h.empty(spark)).count() == 0
    unknown = h.table(spark).withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.classify(unknown).collect()} == {"und"}


def test_no_label_of_the_held_out_fold_is_used(spark, data):
    docs, labels = data
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(common.fold("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))) \
        .withColumn("quality", F.when(common.fold("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    for operator in (quality.classify, toxicity.classify):
        a = {(r["doc_id"], round(r["score"], 9)) for r in operator(docs, labels).collect()}
        b = {(r["doc_id"], round(r["score"], 9)) for r in operator(docs, flipped).collect()}
        assert a == b


def test_training_sample_is_bounded_and_stable(spark):
    frame = spark.range(5000).selectExpr("id as doc_id", "id % 2 as g")
    a = common.bounded_sample(frame, "g", ["doc_id"], 100)
    assert {r["g"]: r["count"] for r in a.groupBy("g").count().collect()} == {0: 100, 1: 100}
    b = common.bounded_sample(frame.repartition(9), "g", ["doc_id"], 100)
    assert {r["doc_id"] for r in a.collect()} == {r["doc_id"] for r in b.collect()}


def test_ftrl_is_sparse_and_uses_skip_grams():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    texts, labels = [], []
    for k in range(400):
        some = list(rng.choice(words, 30))
        labels.append(float(k % 4 == 0))
        some[10:13] = ["bad", "filler%d" % k, "thing"] if k % 4 == 0 else ["bad", "other", "thing2"]
        texts.append(" ".join(some))
    model = toxicity.learn(list(toxicity.features(pa.array(texts))), np.array(labels))
    assert 0 < len(model.index) < 500
    assert (toxicity.scores(pa.array(texts), model) > 0.5).astype(float).tolist() == labels


def test_discriminant_matches_the_density_formula():
    rng = np.random.default_rng(1)
    p = len(quality.STATISTICS)
    moments = {}
    for c, shift in ((0, 0.0), (1, 1.0)):
        x = rng.normal(size=(500, p)) * (1 + c) + shift
        moments[c] = np.concatenate([[500], x.sum(0), (x.T @ x).ravel()])
    model = quality.model_of(moments)
    x = rng.normal(size=(5, p))
    z = (x - model.centre) / model.scale
    want = []
    for row in z:
        d = []
        for m, inverse, log_det in zip(model.means, model.factors, model.log_dets):
            covariance = np.linalg.inv(inverse) @ np.linalg.inv(inverse).T
            assert np.linalg.slogdet(covariance)[1] == pytest.approx(log_det)
            d.append(-0.5 * (row - m) @ np.linalg.solve(covariance, row - m) - 0.5 * log_det)
        want.append(1 / (1 + np.exp(-(d[1] - d[0] + model.log_odds))))
    assert quality.scores(x, model) == pytest.approx(np.array(want))


def test_folded_language_weights_equal_the_kernel_form():
    """Scores by one matrix product are those of the kernel against the landmarks, computed pair by pair."""
    texts = [h.prose(k, 40) if k % 2 else h.prose(k, 40).replace("a", "y").replace("e", "w") for k in range(40)]
    names = ["b" if k % 2 else "a" for k in range(40)]
    model = langid.learn(texts, names)
    best, score = langid.predict(pa.array(texts, pa.large_string()), model)
    assert best.tolist() == names and (score > 0.5).all()

    sets = [set(np.flatnonzero(np.unpackbits(b)).tolist()) for b in langid.spectra(pa.array(texts, pa.large_string()))]
    kernel = lambda x, y: len(x & y) / np.sqrt(max(len(x), 1) * max(len(y), 1))
    marks = [i for name in ("a", "b") for i in [k for k, n in enumerate(names) if n == name][: langid.LANDMARKS]]
    among = np.array([[kernel(sets[i], sets[j]) for j in marks] for i in marks])
    values, vectors = np.linalg.eigh(among)
    alive = values > 1e-6 * values.max()
    whiten = vectors[:, alive] / np.sqrt(values[alive])
    space = np.array([[kernel(s, sets[j]) for j in marks] for s in sets]) @ whiten
    target = np.array([[1.0 if n == name else -1.0 for name in ("a", "b")] for n in names])
    ridge = np.linalg.solve(space.T @ space + langid.RIDGE * len(texts) * np.eye(space.shape[1]), space.T @ target)
    margins = langid.SHARPNESS * space @ ridge
    odds = np.exp(margins) / np.exp(margins).sum(1, keepdims=True)
    assert score == pytest.approx(odds.max(1), abs=1e-3)


def test_language_fit_of_many_languages_is_bounded(spark, monkeypatch):
    rows = [(k, h.prose(k, 12), f"l{k % 10}") for k in range(300)] + [(None, "null id", "l0"), (5, None, "l1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    real = langid.learn_spectra
    monkeypatch.setattr(langid, "MOST_ROWS", 40)
    monkeypatch.setattr(langid, "learn_spectra", lambda bits, names: seen.append((bits.shape, names)) or real(bits, names))
    assert len(langid.fit(docs).languages) == 10
    assert seen[0][0][0] == len(seen[0][1]) <= 40 and seen[0][0][1] == 2048


def ftrl_by_hand(rows, labels):
    """FTRL-proximal with dictionaries, coordinate by coordinate."""
    t = toxicity
    rate = sum(labels) / len(labels)
    z, n, bias, bias_n = {}, {}, float(np.log(rate / (1 - rate))), 0.0
    seen = {}
    for at in rows:
        for j in at.tolist():
            seen[j] = seen.get(j, 0) + 1

    def weight(j):
        if abs(z.get(j, 0.0)) <= t.L1:
            return 0.0
        return -(z[j] - np.sign(z[j]) * t.L1) / ((t.BETA + np.sqrt(n[j])) / t.ALPHA + t.L2)

    for _ in range(t.EPOCHS):
        for at, y in zip(rows, labels):
            x, used = t.value(at), [j for j in at.tolist() if seen[j] >= t.MIN_ROWS]
            w = {j: weight(j) for j in used}
            loss = 1 / (1 + np.exp(-(bias + x * sum(w.values())))) - y
            for j in used:
                before = n.get(j, 0.0)
                n[j] = before + (loss * x) ** 2
                z[j] = z.get(j, 0.0) + loss * x - (np.sqrt(n[j]) - np.sqrt(before)) / t.ALPHA * w[j]
            bias_n += loss * loss
            bias -= 0.1 * loss / (t.BETA + np.sqrt(bias_n))
    return {j: weight(j) for j in z if abs(z[j]) > t.L1}, bias


def test_ftrl_equals_a_plain_version():
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 25))) for _ in range(120)]
    labels = np.array([float("w3" in t.split() or "w7 w8" in t) for t in texts])
    rows = list(toxicity.features(pa.array(texts, pa.large_string())))
    model = toxicity.learn(rows, labels)
    weights, bias = ftrl_by_hand(rows, labels)
    assert model.index.tolist() == sorted(weights) and model.bias == pytest.approx(bias)
    assert model.weight == pytest.approx(np.array([weights[j] for j in sorted(weights)]))


def test_toxicity_features_are_words_stems_pairs_and_skip_grams():
    """Texts share a coordinate exactly where they share one of the named features."""
    def named(text):
        words = [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in h.lower(text)).split()]
        return ({("w", w) for w in words} | {("s", w.encode()[: toxicity.STEM]) for w in words}
                | {("p", a, b) for a, b in zip(words, words[1:])} | {("k", a, b) for a, b in zip(words, words[2:])})

    texts = ["one two three two", "ONE, two; three", "insulting insulted", "é ü ñ", "", "a b a b a b", "x"]
    found = [set(a.tolist()) for a in toxicity.features(pa.array(texts, pa.large_string()))]
    for a, x in zip(texts, found):
        assert len(x) == len(named(a))
        for b, y in zip(texts, found):
            assert len(x & y) == len(named(a) & named(b)), (a, b)


def test_toxicity_sample_keeps_rare_labels_and_shares(spark, monkeypatch):
    """Few toxic rows all stay, the intercept stands for all rows, and reruns over other partitions agree."""
    assert toxicity.quotas({0: 100_000, 1: 500}, 8000) == {0: 7500, 1: 4000} and toxicity.quotas({0: 10, 1: 20}, 8000) == {0: 7980, 1: 7990}
    docs = [(k, f"{h.prose(k, 20)} {'vile' if k % 50 == 0 else ''}") for k in range(1200)] + [(0, "another text of the same id"), (0, None)]
    labels = [(k, int(k % 50 == 0)) for k in range(1200)]
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    models = [toxicity.fit(x, l, max_rows=40) for x in (d, d.repartition(7))]
    assert models[0].bias == models[1].bias and models[0].index.tolist() == models[1].index.tolist()
    assert toxicity.scores(pa.array(["plain words"], pa.large_string()), models[0])[0] < 0.1
    monkeypatch.setattr(toxicity, "MAX_COORDINATES", 500)
    assert toxicity.fit(d, l, max_rows=40).bias < 0
