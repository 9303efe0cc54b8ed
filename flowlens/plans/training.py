"""Train, score and compare the three classifiers."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from flowlens.operators import compare as cp, features as ft, fuzzy as fz, metrics as mt, models as md, patterns as pt, selection as fs
from flowlens.operators.forest import DeepForest
from flowlens.operators.hinge import HingeModel
from flowlens.session import materialize
from flowlens.sources.tables import PREDICTION_COLUMNS


@dataclass
class TrainedSystem:
    """Fitted models with the configuration that feeds them."""

    forest_cfg: md.TrainConfig
    plain_cfg: md.TrainConfig
    forest: PipelineModel | DeepForest
    trees: list[PipelineModel]
    svm: HingeModel
    seconds: dict[str, float] = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        """Predicted class of every model, in the columns the metrics expect."""
        df = md.score(self.svm, df, self.plain_cfg, PREDICTION_COLUMNS["ACA_SVM"])
        df = md.fuzzy_forest_predict(self.forest, df, self.forest_cfg, PREDICTION_COLUMNS["Fuzzy_RF"])
        return md.score_ensemble(self.trees, df, self.plain_cfg, PREDICTION_COLUMNS["IntruDTree"])


@dataclass(frozen=True)
class Sizes:
    trees: int = 200
    depth: int = 30
    tree_depth: int = 30
    svm_cost: float = 50.0


def with_model_inputs(df: DataFrame, patterns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Fuzzy features, and pattern features of the flow tokens when patterns are given."""
    out = fz.with_fuzzy_features(df)
    extra = list(fz.FUZZY_FEATURES)
    if patterns:
        out = pt.aggregates(out.withColumn("__text", ft.flow_text(out)), "__text", patterns).drop("__text")
        extra += ["aca_total_matches", "aca_unique_patterns", "aca_match_density"]
    return out, extra


def train_all(train: DataFrame, features: list[str], fuzzy_features: list[str], sizes: Sizes = Sizes(),
              weight: str | None = "class_weight") -> TrainedSystem:
    """Fit the three models on one written training table."""
    data = materialize(train.select("label_idx", *dict.fromkeys([*features, *fuzzy_features])), "train")
    ranked = [r["feature"] for r in fs.anova_f(data, features, "label_idx").orderBy(F.desc_nulls_last("f_score"), "feature").collect()]
    plain = md.TrainConfig(features=tuple(ranked), weight=weight)  # one row per feature
    forest_cfg = md.TrainConfig(features=tuple(dict.fromkeys([*features, *fuzzy_features])), weight=weight)
    seconds: dict[str, float] = {}

    def timed(name, fit):
        start = time.perf_counter()
        model = fit()
        seconds[name] = time.perf_counter() - start
        return model

    return TrainedSystem(
        forest_cfg, plain,
        forest=timed("Fuzzy_RF", lambda: md.random_forest(data, forest_cfg, sizes.trees, sizes.depth)),
        trees=timed("IntruDTree", lambda: md.tree_ensemble(data, plain, max_depth=sizes.tree_depth)),
        svm=timed("ACA_SVM", lambda: md.rbf_svm(data, plain, sizes.svm_cost)),
        seconds=seconds)


def compare(scored: DataFrame) -> dict[str, DataFrame]:
    """Comparison tables of scored rows; one pass over them."""
    conf = mt.confusion(scored)
    quality = mt.quality(conf)
    long = cp.long_metrics(quality)
    return {
        "evaluation": mt.evaluate(scored), "ranking": cp.overall_rank(long), "best": cp.best_models(long),
        "statistics": cp.metric_statistics(long), "strengths": cp.strengths(long),
        "ensemble": cp.ensemble_recommendation(long),
    }


def run(prepared: DataFrame, features: list[str], sizes: Sizes = Sizes()) -> tuple[TrainedSystem, dict[str, DataFrame]]:
    """Train on the train side, score the test side, compare."""
    rows, extra = with_model_inputs(prepared)
    system = train_all(rows.filter("split = 'train'"), features, extra, sizes)
    scored = materialize(system.score(rows.filter(F.col("split") == "test")), "scored")
    return system, compare(scored)
