"""Raw flow table to train/test table."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from flowlens.operators import balance as bl, clean as cl, encode as en, features as ft, sampling as sp, scaling as sc
from flowlens.session import materialize, small_methods
from flowlens.sources import artifacts as ar, sinks
from flowlens.sources.schema import numeric_columns, resolve_columns, string_columns, with_ips, with_label


@dataclass(frozen=True)
class PreprocessConfig:
    key: str = "flow_id"
    label: str = "label"
    test_fraction: float = 0.3
    seed: int = 42
    scaler: str = "minmax"
    fit_on: str = "train"          # "all" fits the scaler on every row
    impute: bool = False           # False fills missing values with 0
    sample_size: int | None = None
    stratify: bool = True          # exact per-class test quota; False splits by hash alone
    resample: bool | None = None   # None: when the largest class has over 5 times the smallest


@dataclass(frozen=True)
class Preprocessed:
    data: DataFrame                # features, label_idx, metadata, split
    features: list[str]
    stats: dict[str, Any]          # fitted scaler and feature statistics


def preprocess(raw: DataFrame, cfg: PreprocessConfig = PreprocessConfig()) -> Preprocessed:
    """Clean, encode, derive, split, scale.

    The cleaned, engineered and scaled rows are written once each: later passes
    (statistics, dictionaries, scaler fit, splits) read a table instead of
    repeating the duplicate removal, and the logical plan of a pass stays small.
    """
    with small_methods(raw.sparkSession):
        return _preprocess(raw, cfg)


def _preprocess(raw: DataFrame, cfg: PreprocessConfig) -> Preprocessed:
    df = with_ips(with_label(resolve_columns(raw), cfg.label))
    if cfg.key not in df.columns:
        df = df.withColumn(cfg.key, F.sha2(F.to_json(F.struct("*")), 256))  # exports without an id: one of the whole row
    if cfg.sample_size is not None:
        df = materialize(sp.sample_exact(df, cfg.key, cfg.sample_size, cfg.seed), "sample")
    df = materialize(cl.clean(df), "clean")
    feature_stats = ft.feature_stats(df)
    codings = [en.label_coding(cfg.label)]
    if "protocol" in df.columns:
        codings.append(en.Coding("protocol", "protocol_encoded"))
    meta = ("flow_id", "src_ip", "dst_ip", "ts", cfg.label)
    strings = string_columns(df, meta)
    plan = en.plan_categoricals(df, strings) if strings else en.CategoricalPlan((), ())
    df = en.encode_columns(df, codings + en.categorical_codings(plan)).drop(*plan.encode, *plan.drop)
    df = ft.engineer(df, feature_stats)
    booleans = [f.name for f in df.schema.fields if f.dataType.simpleString() == "boolean"]
    df = df.withColumns({c: F.col(c).cast("int") for c in booleans}) if booleans else df
    df = materialize(df, "engineered")
    # a comparison of the row's hash with its class's cut: no row moves, so the split is not written
    df = sp.split_exact(df, cfg.key, "label_idx", cfg.test_fraction, cfg.seed) if cfg.stratify \
        else sp.split_hash(df, cfg.key, cfg.test_fraction, cfg.seed)
    columns = numeric_columns(df, ("label_idx", "src_port", "dst_port"))

    def filled(rows: DataFrame) -> DataFrame:
        rows = cl.nullify_non_finite(rows)
        return rows if cfg.impute else rows.na.fill(0, subset=columns)

    fit_rows = df if cfg.fit_on == "all" else df.filter("split = 'train'")
    scaler = sc.fit_scaler(filled(fit_rows), columns, impute=cfg.impute)
    scaled = materialize(sc.scale(filled(df), columns, scaler, cfg.scaler, impute=cfg.impute), "scaled")
    resample = cfg.resample
    if resample is None:
        resample = bool(bl.imbalance(scaled.filter("split = 'train'"), "label_idx").first()["imbalanced"])
    if resample:
        train = bl.expand(bl.resample(scaled.filter("split = 'train'"), cfg.key, "label_idx", "minority", cfg.seed))
        scaled = train.unionByName(scaled.filter("split = 'test'"))
    return Preprocessed(scaled, columns, {"scaler": scaler, "features": feature_stats})


def save(result: Preprocessed, path: str, cfg: PreprocessConfig, classes: list[str]) -> None:
    """Processed table, run description and fitted numbers below one folder."""
    spark = result.data.sparkSession
    sinks.write_processed(result.data, f"{path}/data")
    weights = bl.class_weights(sinks.read_processed(spark, f"{path}/data", "train"), "label_idx")
    sinks.write_json(sinks.preprocessing_info(result.data, result.features, classes, weights, cfg.scaler),
                     f"{path}/info")
    ar.save_stats(spark, result.stats, f"{path}/stats")
