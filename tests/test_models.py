"""Invariants of fitted models."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import hinge, models as md
from flowlens.queries.learning import CFG, split_flows


@pytest.fixture(scope="module")
def data(spark, sf):
    return split_flows(spark, sf)


def test_forest_probabilities(data):
    train, test = data
    scored = md.score(md.random_forest(train, CFG, trees=3, depth=4), test, CFG, "pred", probability="p")
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    r = scored.agg(F.min(total), F.max(total), F.count_if(md.argmax(F.col("p")) != F.col("pred"))).first()
    assert r[0] == pytest.approx(1) and r[1] == pytest.approx(1) and r[2] == 0
    assert scored.columns == [*test.columns, "pred", "p"]


def test_tree_paths_agree_with_predictions(data):
    train, test = data
    model = md.entropy_tree(train, CFG, depth=4)
    paths = md.decision_paths(model, test, CFG, "flow_id")
    assert paths.count() == test.count()
    per_path = paths.groupBy("path").agg(F.count_distinct("prediction").alias("k")).agg(F.max("k")).first()[0]
    assert per_path == 1
    # A row satisfies the conditions of its own path.
    joined = test.join(paths, "flow_id")
    for r in paths.select("path").distinct().collect():
        inside = joined.filter(F.col("path") == r["path"])
        # flow_id repeats in the bag, so compare the count of distinct satisfying rows per path
        assert inside.filter(r["path"]).count() > 0


def test_importances_sum_to_one(spark, data):
    imp = md.feature_importance(md.random_forest(data[0], CFG, trees=3, depth=4), CFG, spark)
    assert imp.agg(F.sum("importance")).first()[0] == pytest.approx(1)


def clusters(spark, n=240):
    rows = [(i, float((i % 3) * 2 + (i * 37 % 11) / 10), float((i % 3 == 1) * 3 - (i * 53 % 13) / 10), None if i % 40 == 0 else 7.0, i % 3, i % 4)
            for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, constant double, label int, fold int")


def loss_by_hand(x, y, w, cost, c):
    """Objective of one class's problem, row by row."""
    total = 0.5 * sum(v * v for v in w[:-1])
    size, own = len(y), sum(v == c for v in y)
    for row, label in zip(x, y):
        f = sum(a * b for a, b in zip(row, w[:-1])) + w[-1]
        weight = size / (2 * own) if label == c else size / (2 * (size - own))
        total += cost * weight * max(0.0, 1 - (f if label == c else -f)) ** 2
    return total


@pytest.mark.parametrize("gamma", [None, 0.5])
def test_svm_finds_the_least_loss(spark, gamma):
    """No small move of any weight lowers the objective, and the classes come apart."""
    df = clusters(spark)
    features = ["a", "b", "constant"]
    model = hinge.fit(df, features, "label", cost=2.0, gamma=gamma, n_out=16)
    assert model.converged and model.classes == (0, 1, 2)
    rows = df.collect()
    x = model.view.design(np.array([[r["a"], r["b"], r["constant"] or 0.0] for r in rows]))[:, :-1]
    y = [r["label"] for r in rows]
    for j, c in enumerate(model.classes):
        w = model.weights[:, j]
        least = loss_by_hand(x, y, w, 2.0, c)
        for k in range(len(w)):
            for step in (-1e-3, 1e-3):
                moved = w.copy()
                moved[k] += step
                assert loss_by_hand(x, y, moved, 2.0, c) >= least - 1e-6 * (1 + least)
    scored = model.score(df, "pred", keep_raw="raw").collect()
    assert sum(r["pred"] == r["label"] for r in scored) > 0.9 * len(scored)
    for r, row in zip(sorted(scored, key=lambda r: r["id"]), x):
        assert r["raw"] == pytest.approx(list(row @ model.weights[:-1] + model.weights[-1]), abs=1e-9)


def test_svm_store_and_awkward_tables(spark, tmp_path):
    df = clusters(spark, 60)
    model = hinge.fit(df, ["a", "b"], "label", gamma=0.3, n_out=8)
    model.save(spark, str(tmp_path / "svm"))
    again = hinge.HingeModel.load(spark, str(tmp_path / "svm"))
    assert [r["p"] for r in again.score(df, "p").orderBy("id").collect()] == [r["p"] for r in model.score(df, "p").orderBy("id").collect()]
    one = hinge.fit(df.filter("label = 1"), ["a", "b"], "label")
    assert one.converged and {r["p"] for r in one.score(df, "p").collect()} == {1}


def test_grid_points_equal_their_own_fits(spark):
    """A point of the joint search has the F1 of models fitted fold by fold."""
    df = clusters(spark)
    found = {(r["cost"], r["gamma"]): r for r in hinge.search(df, ["a", "b"], "label", "fold", [0.5, 5.0], [None, 0.2], n_out=8).collect()}
    assert len(found) == 4 and all(r["n"] == df.count() and r["converged"] for r in found.values())
    for (cost, gamma), r in found.items():
        scores = []
        for k in range(4):
            model = hinge.fit(df.filter(F.col("fold") != k), ["a", "b"], "label", cost, gamma, n_out=8)
            held = model.score(df.filter(F.col("fold") == k), "pred")
            scores.append(hinge.weighted_f1(held, [], "label", "pred").first()["f1"])
        assert r["f1"] == pytest.approx(sum(scores) / 4, abs=1e-9)


def test_weighted_f1_and_vote_weights(spark):
    rows = [(k % 3, k % 2, k % 2, 1 - k % 2, 0) for k in range(30)]
    calls = spark.createDataFrame(rows, "fold int, y int, right int, wrong int, one int")
    found = {r["model"]: r for r in md.vote_weights(calls, "y", "fold", ["right", "wrong", "one"]).collect()}
    assert found["right"]["f1"] == 1 and found["wrong"]["f1"] == 0
    assert found["one"]["f1"] == pytest.approx(0.5 * 2 / 3)
    assert sum(r["weight"] for r in found.values()) == pytest.approx(1)
    none = md.vote_weights(calls, "y", "fold", ["wrong"]).first()
    assert none["weight"] == 1.0


def test_equal_variants_share_a_fit(data):
    trees = md.tree_ensemble(data[0], CFG, [(4, 1, 10), (4, 1, 10), (3, 1, 10)])
    assert trees[0] is trees[1] and trees[2] is not trees[0]


def test_fourier_features_approximate_the_kernel(spark):
    rows = [(float(i % 3), float(i % 5) / 2) for i in range(15)]
    df = spark.createDataFrame(rows, "a double, b double")
    out, names = md.with_fourier_features(df, ["a", "b"], n_out=600, gamma=0.2)
    z = [[r[n] for n in names] for r in out.collect()]
    for i, j in [(0, 1), (2, 7), (3, 3)]:
        want = math.exp(-0.2 * sum((p - q) ** 2 for p, q in zip(rows[i], rows[j])))
        assert sum(p * q for p, q in zip(z[i], z[j])) == pytest.approx(want, abs=0.12)
