"""Classifiers as Spark ML pipelines, ensembles, tuning and explanations."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowlens import fixed_values as fv
from flowlens.functions.keys import hash_bucket, key_hash
from flowlens.functions.numeric import as_col
from flowlens.functions.quantile import exact_quantiles
from flowlens.operators import forest, hinge
from flowlens.operators.balance import class_weights, with_class_weight
from flowlens.operators.fuzzy import override_prediction
from flowlens.session import materialize

MAX_DEPTH = 30  # upper bound of Spark's tree learner
PASSES_DEPTH = 12  # deeper forests have more nodes than passes over dense histograms can hold


@dataclass(frozen=True)
class TrainConfig:
    """Training options; columns are names in the feature table."""

    features: tuple[str, ...]
    label: str = "label_idx"
    weight: str | None = "class_weight"
    seed: int = 42
    max_bins: int = 64
    extra: dict[str, Any] = field(default_factory=dict)


def assembler(cfg: TrainConfig, out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cfg.features), outputCol=out, handleInvalid="keep")


def prepare(df: DataFrame, cfg: TrainConfig) -> DataFrame:
    """Only the columns a fit needs, NULL features as 0, with class weights."""
    keep = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cfg.features]
    slim = df.select(F.col(cfg.label).cast("double").alias(cfg.label), *keep)
    return with_class_weight(slim, cfg.label, cfg.weight) if cfg.weight else slim


def _weighted(est, cfg: TrainConfig):
    return est.setWeightCol(cfg.weight) if cfg.weight else est


def random_forest(df: DataFrame, cfg: TrainConfig, trees: int = 100, depth: int = 10) -> PipelineModel | forest.DeepForest:
    """Class-weighted random forest."""
    if min(depth, MAX_DEPTH) > PASSES_DEPTH:
        classes = {int(r[cfg.label]): r["weight"] if cfg.weight else 1.0 for r in class_weights(df.filter(F.col(cfg.label).isNotNull()), cfg.label).collect()}
        return forest.fit(df, list(cfg.features), cfg.label, classes, trees, min(depth, MAX_DEPTH), cfg.max_bins, cfg.seed)
    rf = RandomForestClassifier(labelCol=cfg.label, numTrees=trees, maxDepth=min(depth, MAX_DEPTH),
                                maxBins=cfg.max_bins, seed=cfg.seed, cacheNodeIds=False)
    return Pipeline(stages=[assembler(cfg), _weighted(rf, cfg)]).fit(prepare(df, cfg))


def entropy_tree(df: DataFrame, cfg: TrainConfig, depth: int = 10, min_leaf: int = 1) -> PipelineModel:
    """Entropy decision tree that also reports the leaf of each row."""
    dt = DecisionTreeClassifier(labelCol=cfg.label, impurity="entropy", maxDepth=min(depth, MAX_DEPTH),
                                maxBins=cfg.max_bins, minInstancesPerNode=min_leaf, seed=cfg.seed, leafCol="leaf")
    return Pipeline(stages=[assembler(cfg), _weighted(dt, cfg)]).fit(prepare(df, cfg))


TREE_VARIANTS = fv.TREE_VARIANTS


def tree_ensemble(df: DataFrame, cfg: TrainConfig, variants: list[tuple[int, int, int]] = TREE_VARIANTS,
                  max_depth: int = MAX_DEPTH) -> list[PipelineModel]:
    """Entropy trees over the leading features of ``cfg`` (ranked best first).

    Where a bound of Spark's tree learner or of the table is reached, the variants
    keep their distances: the deepest tree has ``max_depth`` and the others as many
    levels less as they had, the widest has all features and the others their share.
    """
    effective = effective_variants(variants, len(cfg.features), max_depth)
    data = prepare(df, cfg).cache()
    try:
        fitted = {}
        for depth, leaf, n in dict.fromkeys(effective):
            sub = TrainConfig(features=cfg.features[:n], label=cfg.label, weight=cfg.weight, seed=cfg.seed)
            dt = DecisionTreeClassifier(labelCol=cfg.label, impurity="entropy", maxDepth=depth,
                                        maxBins=cfg.max_bins, minInstancesPerNode=leaf, seed=cfg.seed)
            fitted[depth, leaf, n] = Pipeline(stages=[assembler(sub), _weighted(dt, cfg)]).fit(data)
        return [fitted[v] for v in effective]
    finally:
        data.unpersist()


def effective_variants(variants: list[tuple[int, int, int]], features: int, max_depth: int) -> list[tuple[int, int, int]]:
    """Variants within the bounds, still different from each other."""
    deepest, widest = max(d for d, _, _ in variants), max(n for _, _, n in variants)
    over = max(deepest - max_depth, 0)
    wide = min(features / widest, 1.0)
    return [(max(d - over, 1), leaf, max(1, math.ceil(n * wide))) for d, leaf, n in variants]


def score(model: PipelineModel | hinge.HingeModel | forest.DeepForest, df: DataFrame, cfg: TrainConfig, out: str,
          probability: str | None = None, keep_raw: str | None = None) -> DataFrame:
    """Add the predicted class (and optionally the probability array) to ``df``."""
    if isinstance(model, hinge.HingeModel):
        return model.score(df, out, keep_raw)
    if isinstance(model, forest.DeepForest):
        return model.score(df, out, probability, keep_raw)
    filled = df.withColumns({f"__in_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cfg.features})
    renamed = model.copy()
    used = model.stages[0].getInputCols()
    renamed.stages[0].setInputCols([f"__in_{c}" for c in used])
    scored = renamed.transform(filled)
    drop = {"features", "scaled", "rawPrediction", "probability", "prediction", "leaf"} - set(df.columns)
    scored = scored.withColumn(out, F.col("prediction").cast("int"))
    if probability:
        scored = scored.withColumn(probability, vector_to_array("probability"))
    if keep_raw:
        scored = scored.withColumn(keep_raw, vector_to_array("rawPrediction"))
    return scored.drop(*[c for c in drop if c in scored.columns], *[f"__in_{c}" for c in cfg.features])


def vote(predictions: list[Column]) -> Column:
    """Most frequent class of a row; ties go to the lowest class index."""
    votes = F.array(*predictions)
    tally = F.transform(F.array_distinct(votes), lambda c: F.struct(
        F.size(F.filter(votes, lambda v: v == c)).alias("n"), (-c).alias("c")))
    return -F.array_max(tally)["c"]


def score_ensemble(models: list[PipelineModel], df: DataFrame, cfg: TrainConfig, out: str) -> DataFrame:
    names = [f"{out}_{i}" for i in range(len(models))]
    for m, n in zip(models, names):
        df = score(m, df, cfg, n)
    return df.withColumn(out, vote([F.col(n) for n in names]).cast("int")).drop(*names)


def fuzzy_forest_predict(model: PipelineModel, df: DataFrame, cfg: TrainConfig, out: str) -> DataFrame:
    """Forest prediction with doubtful benign calls overridden; ``<out>_raw`` is the forest's own."""
    scored = score(model, df, cfg, f"{out}_raw", probability=f"{out}_probability")
    call = override_prediction(F.col(f"{out}_probability"), F.col(f"{out}_raw"), F.col("fuzzy_score"))
    return scored.withColumn(out, call)


# --- support vector machines ------------------------------------------------------
def linear_svm(df: DataFrame, cfg: TrainConfig, cost: float = 1.0) -> hinge.HingeModel:
    """One-vs-rest SVM of the standardised features; in each problem the class and the rest weigh the same."""
    return hinge.fit(df, list(cfg.features), cfg.label, cost)


def rbf_svm(df: DataFrame, cfg: TrainConfig, cost: float = 50.0, gamma: float | None = None, n_out: int = 64) -> hinge.HingeModel:
    """The same with an RBF kernel; the width of standardised features is 1 / features unless given."""
    return hinge.fit(df, list(cfg.features), cfg.label, cost, gamma or 1.0 / len(cfg.features), n_out, cfg.seed)


def fourier_weights(n_in: int, n_out: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random frequencies and phases of the RBF kernel exp(-gamma |x-y|^2)."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, math.sqrt(2 * gamma), (n_out, n_in)), rng.uniform(0, 2 * math.pi, n_out)


def with_fourier_features(df: DataFrame, columns: list[str], n_out: int = 32, gamma: float = 0.1,
                          seed: int = 42) -> tuple[DataFrame, list[str]]:
    """Random Fourier features of standardised columns (Rahimi & Recht 2007).

    The projection is a fixed matrix, so each feature is one JVM expression.
    """
    w, b = fourier_weights(len(columns), n_out, gamma, seed)
    names = [f"rff_{i}" for i in range(n_out)]
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]

    def project(i: int) -> Column:
        dot = reduce(lambda a, c: a + c, [x[j] * F.lit(float(w[i, j])) for j in range(len(columns))])
        return F.cos(dot + F.lit(float(b[i]))) * F.lit(math.sqrt(2.0 / n_out))

    return df.withColumns({n: project(i) for i, n in enumerate(names)}), names


def confidence(probability: Column | None = None, decision: Column | None = None) -> Column:
    """Largest probability; else |score| for one decision value, else the largest
    score after division by the largest magnitude; 1 when nothing is known.

    From several decision values it lies in -1 to 1: negative where every class is rejected.
    """
    if probability is not None:
        return F.array_max(probability)
    if decision is None:
        return F.lit(1.0)
    biggest = F.array_max(F.transform(decision, lambda d: F.abs(d)))
    multi = F.array_max(F.transform(decision, lambda d: d / (biggest + F.lit(1e-8))))
    return F.when(F.size(decision) == 1, F.abs(F.get(decision, F.lit(0)))).otherwise(multi)


# --- tuning and cross-validation -----------------------------------------------------
def with_fold(df: DataFrame, key: str | Column, folds: int = 3, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold number from the row key: repeatable, no shuffle."""
    return df.withColumn(out, F.pmod(hash_bucket(key_hash(as_col(key), seed), 8), F.lit(folds)).cast("int"))


def out_of_fold(df: DataFrame, cfg: TrainConfig, fold: str, fit, out: str, folds: int = 3) -> DataFrame:
    """Probability of every row from the model that did not see its fold."""
    parts = []
    for k in range(folds):
        model = fit(df.filter(F.col(fold) != k), cfg)
        parts.append(score(model, df.filter(F.col(fold) == k), cfg, f"{out}_pred", probability=out))
    return reduce(lambda a, b: a.unionByName(b), parts).drop(f"{out}_pred")


def out_of_fold_calls(df: DataFrame, cfg: TrainConfig, fold: str, learners: dict[str, Any], folds: int = 3) -> DataFrame:
    """``df`` with one column per learner: the class that the learner fitted on the other folds gives the row."""
    parts = []
    for k in range(folds):
        held = df.filter(F.col(fold) == k)
        for name, fit in learners.items():
            held = score(fit(df.filter(F.col(fold) != k), cfg), held, cfg, name)
        parts.append(held)
    return materialize(reduce(lambda a, b: a.unionByName(b), parts), "out-of-fold")


def vote_weights(calls: DataFrame, label: str, fold: str, models: list[str]) -> DataFrame:
    """model, f1, weight: the mean over folds of each model's weighted F1 and its share of their sum; equal shares if all are zero.

    ``calls`` has one column of out-of-fold classes per model; one pass, and one row per model comes out.
    """
    named = [F.struct(F.lit(m).alias("model"), F.col(m).cast("int").alias("call")) for m in models]
    rows = calls.select(F.col(fold).alias("__fold"), F.col(label).cast("int").alias("__y"), F.explode(F.array(*named)).alias("__m"))
    per_fold = hinge.weighted_f1(rows.select("__fold", "__y", "__m.model", "__m.call"), ["model", "__fold"], "__y", "call")
    f1 = per_fold.groupBy("model").agg(F.avg("f1").alias("f1"))
    total = F.sum("f1").over(Window.partitionBy(F.lit(0)))  # one row per model
    return f1.withColumn("weight", F.when(total > 0, F.col("f1") / total).otherwise(F.lit(1.0 / len(models))))


def fit_weighted(df: DataFrame, cfg: TrainConfig, fold: str, learners: dict[str, Any], folds: int = 3) -> tuple[dict[str, Any], dict[str, float]]:
    """(models fitted on all rows, their weights from cross-validated F1)."""
    found = vote_weights(out_of_fold_calls(df, cfg, fold, learners, folds), cfg.label, fold, list(learners))
    weights = {r["model"]: r["weight"] for r in found.collect()}
    return {name: fit(df, cfg) for name, fit in learners.items()}, {m: weights.get(m, 0.0) for m in learners}


def score_weighted(models: dict[str, Any], weights: dict[str, float], df: DataFrame, cfg: TrainConfig, out: str) -> DataFrame:
    """Class with the largest summed weight over the models' calls."""
    names = {m: f"{out}_{i}" for i, m in enumerate(models)}
    for m, model in models.items():
        df = score(model, df, cfg, names[m])
    return df.withColumn(out, weighted_vote({m: F.col(c) for m, c in names.items()}, weights)).drop(*names.values())


def stack(df: DataFrame, cfg: TrainConfig, fold: str, learners: dict[str, Any], n_classes: int,
          folds: int = 3, iterations: int = 50) -> tuple[PipelineModel, dict[str, PipelineModel], TrainConfig]:
    """Logistic regression over out-of-fold class probabilities of the learners."""
    staged = df
    for name, fit in learners.items():
        staged = out_of_fold(staged, cfg, fold, fit, f"p_{name}", folds)
    meta, names = probability_columns(materialize(staged, "out-of-fold"), list(learners), n_classes)
    meta_cfg = TrainConfig(features=tuple(names), label=cfg.label, weight=cfg.weight, seed=cfg.seed)
    lr = LogisticRegression(labelCol=cfg.label, maxIter=iterations, regParam=0.001)
    top = Pipeline(stages=[assembler(meta_cfg), _weighted(lr, meta_cfg)]).fit(prepare(meta, meta_cfg))
    return top, {name: fit(df, cfg) for name, fit in learners.items()}, meta_cfg


def probability_columns(df: DataFrame, learners: list[str], n_classes: int) -> tuple[DataFrame, list[str]]:
    cols = {f"p_{m}_{k}": F.coalesce(F.get(f"p_{m}", F.lit(k)), F.lit(0.0)) for m in learners for k in range(n_classes)}
    return df.withColumns(cols), list(cols)


def score_stack(top: PipelineModel, base: dict[str, PipelineModel], meta_cfg: TrainConfig, df: DataFrame,
                cfg: TrainConfig, n_classes: int, out: str) -> DataFrame:
    staged = df
    for name, model in base.items():
        staged = score(model, staged, cfg, f"__pred_{name}", probability=f"p_{name}")
    meta, names = probability_columns(staged, list(base), n_classes)
    drop = names + [f"p_{m}" for m in base] + [f"__pred_{m}" for m in base]
    return score(top, meta, meta_cfg, out).drop(*drop)


# --- votes over given predictions -------------------------------------------------------
def soft_vote(probabilities: list[Column]) -> Column:
    """Mean probability per class."""
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), probabilities)
    return F.transform(total, lambda x: x / len(probabilities))


def argmax(p: Column) -> Column:
    """Index of the largest value; ties go to the lowest index."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def weighted_vote(predictions: dict[str, Column], weights: dict[str, float]) -> Column:
    """Class with the largest summed weight; equal weights if all are zero; ties to the lowest class."""
    total = sum(weights.values())
    w = {m: (weights[m] / total if total > 0 else 1.0 / len(weights)) for m in predictions}
    votes = F.array(*[F.struct(c.alias("c"), F.lit(w[m]).alias("w")) for m, c in predictions.items()])
    classes = F.array_distinct(F.transform(votes, lambda v: v["c"]))
    tally = F.transform(classes, lambda c: F.struct(
        F.round(F.aggregate(F.filter(votes, lambda v: v["c"] == c), F.lit(0.0), lambda a, v: a + v["w"]), 12).alias("w"),
        (-c).alias("c")))
    return -F.array_max(tally)["c"]


# --- explanations -------------------------------------------------------------------------
def feature_importance(model: PipelineModel, cfg: TrainConfig, spark: SparkSession) -> DataFrame:
    """``(feature, importance)`` sorted descending; coefficients count by magnitude."""
    own = (hinge.HingeModel, forest.DeepForest)
    last = model if isinstance(model, own) else model.stages[-1]
    if isinstance(last, own):
        values = last.importances()
    elif hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    else:
        values = np.abs(last.coefficientMatrix.toArray()).mean(axis=0)
    rows = [(f, float(v)) for f, v in zip(cfg.features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def leaf_paths(model: PipelineModel, cfg: TrainConfig, spark: SparkSession) -> DataFrame:
    """``(leaf, path, depth)`` of a fitted tree: its nodes, never the data."""
    tree = model.stages[-1]
    rows: list[tuple[float, str, int]] = []

    def descend(node, conditions: list[str]) -> None:
        if node.numDescendants() == 0:
            rows.append((float(len(rows)), " AND ".join(conditions) or "(root)", len(conditions)))
            return
        split = node.split()
        name = cfg.features[split.featureIndex()]
        descend(node.leftChild(), conditions + [f"{name} <= {split.threshold():.6g}"])
        descend(node.rightChild(), conditions + [f"{name} > {split.threshold():.6g}"])

    descend(tree._call_java("rootNode"), [])
    return spark.createDataFrame(rows, "leaf double, path string, depth int")


def decision_paths(model: PipelineModel, df: DataFrame, cfg: TrainConfig, key: str) -> DataFrame:
    """Key, predicted class and the path taken; leaves are numbered in pre-order."""
    filled = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cfg.features])
    leaves = model.transform(filled).select(key, F.col("prediction").cast("int").alias("prediction"), "leaf")
    paths = leaf_paths(model, cfg, df.sparkSession)
    return leaves.join(paths, "leaf").drop("leaf")


def eliminate(df: DataFrame, cfg: TrainConfig, keep: int) -> list[str]:
    """Recursive elimination: drop the weakest logistic coefficient until ``keep`` remain.

    Features are standardised once; the loop is over features, not rows.
    """
    names = list(cfg.features)
    data = prepare(df, cfg).cache()
    try:
        while len(names) > keep:
            step = TrainConfig(features=tuple(names), label=cfg.label, weight=cfg.weight)
            lr = LogisticRegression(labelCol=cfg.label, maxIter=20, regParam=0.01, featuresCol="scaled")
            pipe = Pipeline(stages=[assembler(step), StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
                                    _weighted(lr, cfg)])
            coef = np.abs(pipe.fit(data).stages[-1].coefficientMatrix.toArray()).sum(axis=0)
            names.pop(int(np.argmin(coef)))
    finally:
        data.unpersist()
    return names


def subset_sizes(features: int, first: int = 10, step: int = 5) -> list[int]:
    """Sizes to try: from ``first`` in steps up to all features; a set that is no larger than ``first`` in steps of two."""
    sizes = list(range(first, features + 1, step)) if features > first else list(range(2, features + 1, 2))
    return sorted({*sizes, features}) if features else []


def binned(df: DataFrame, cfg: TrainConfig, fold: str, bins: int = 32) -> DataFrame:
    """Label, fold and every feature as the number of its equal-frequency bin, written once."""
    filled = df.select(cfg.label, fold, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cfg.features])
    cuts = exact_quantiles(filled, {c: [i / bins for i in range(1, bins)] for c in cfg.features})

    def place(c: str) -> Column:
        edges = sorted({v for (name, _), v in cuts.items() if name == c and v is not None})
        if not edges:
            return F.lit(0.0)
        return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(c))).cast("double")

    return materialize(filled.select(F.col(cfg.label).cast("double").alias(cfg.label), fold, *[place(c).alias(c) for c in cfg.features]), "binned")


def subset_search(df: DataFrame, cfg: TrainConfig, ranked: list[str], fold: str, sizes: list[int] | None = None,
                  trees: int = 50, folds: int = 3, parallelism: int = 4) -> DataFrame:
    """n_features, f1 (mean of the folds' weighted F1 of a forest on the first n ranked features), n (rows scored).

    One binned table serves all fits; sizes and folds are fitted side by side, and one
    query scores all of them.
    """
    spark = df.sparkSession
    table = binned(df, TrainConfig(features=tuple(ranked), label=cfg.label), fold)
    tasks = [(n, k) for n in sizes or subset_sizes(len(ranked)) for k in range(folds)]

    def fit(task: tuple[int, int]) -> DataFrame:
        n, k = task
        rf = RandomForestClassifier(labelCol=cfg.label, numTrees=trees, maxDepth=8, maxBins=64, seed=cfg.seed)
        model = Pipeline(stages=[VectorAssembler(inputCols=ranked[:n], outputCol="features"), rf]).fit(table.filter(F.col(fold) != k))
        held = model.transform(table.filter(F.col(fold) == k))
        return held.select(F.lit(n).alias("n_features"), F.lit(k).alias("fold"), F.col(cfg.label).cast("int").alias("y"), F.col("prediction").cast("int").alias("call"))

    with ThreadPool(min(parallelism, len(tasks))) as pool:
        calls = reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(spark)(fit), tasks))
    per_fold = hinge.weighted_f1(calls, ["n_features", "fold"], "y", "call")
    return per_fold.groupBy("n_features").agg(F.avg("f1").alias("f1"), F.sum("n").alias("n"))
