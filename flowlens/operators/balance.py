"""Class counts, weights and rebalancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.keys import hash_bucket, hash_uniform, key_hash
from flowlens.functions.numeric import as_col
from flowlens.functions.stats import over_all
from flowlens.operators.sampling import numbered
from flowlens.session import materialize

DRAWS_PER_TASK = 100_000
MOST_RATE = 400.0


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, pct)``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / over_all(F.sum("n")))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights N / (K * n_c)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total, k = over_all(F.sum("n")), over_all(F.count(F.lit(1)))
    return counts.withColumn("weight", total.cast("double") / (k * F.col("n")))


def with_class_weight(df: DataFrame, label: str, out: str = "class_weight") -> DataFrame:
    """Weight of each row's class.

    The per-class table is written first: its size is then known, and the join
    never shuffles the rows by label unless there are very many classes.
    """
    weights = materialize(class_weights(df, label).select(F.col(label).alias("__l"), F.col("weight").alias(out)), "weights")
    return df.join(weights, F.col(label).eqNullSafe(F.col("__l")), "left").drop("__l")


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """Largest/smallest class, their ratio both ways and the flags read from it."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.max("n").alias("max_count"), F.min("n").alias("min_count"),
        F.try_divide(F.max("n"), F.min("n")).alias("imbalance_ratio"),
        F.try_divide(F.min("n"), F.max("n")).alias("balance_ratio"),
    ).withColumns({
        "imbalanced": F.col("imbalance_ratio") > 5,
        "severe": F.col("imbalance_ratio") > 10,
        "balanced": F.col("balance_ratio") > 0.9,
    })


def minority_target() -> Column:
    """Upsample target max(20% of the largest class, 100); larger classes stay as they are."""
    largest, smallest = over_all(F.max("n")), over_all(F.min("n"))
    target = F.greatest(F.floor(largest * F.lit(0.2)), F.lit(100))
    return F.when((F.try_divide(largest, smallest) > 5) & (F.col("n") < target), target)


def median_target() -> Column:
    """Every class to the median class size unless already balanced."""
    return F.when(over_all(F.min("n")) / over_all(F.max("n")) <= 0.9, F.floor(over_all(F.median("n"))))


def tiered_target() -> Column:
    """Target size by severity of the imbalance; none at a ratio of 2 or less."""
    hi, lo = over_all(F.max("n")), over_all(F.min("n"))
    ratio = F.try_divide(hi, lo)
    return (
        F.when(ratio > 10, F.floor(lo * F.lit(1.5)))
        .when(ratio > 5, F.floor(lo * F.lit(1.2)))
        .when(ratio > 2, F.floor((hi + lo) / 2))
    )


TARGETS = {"minority": minority_target, "median": median_target, "tiered": tiered_target}


def targets(df: DataFrame, label: str, policy: str) -> DataFrame:
    """``(label, n, target)``, written once; a NULL target leaves the class as it is."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return materialize(counts.withColumn("target", TARGETS[policy]().cast("bigint")), "targets")


def draws(plan: DataFrame, label: str, seed: int) -> DataFrame:
    """``(label, row_idx, copies)``: with-replacement draws per class.

    Draw j of class c hits row ``hash(c, j) mod n``.  Draws are generated in
    blocks spread over tasks, counted per row before the join.  No estimate counts the
    rows of an explode, so a join would broadcast all draws through the driver; the hint has
    it merge instead.
    """
    blocks = plan.filter("target > 0").select(
        label, "n", "target",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("target") / DRAWS_PER_TASK) - 1)).alias("__block"),
    ).repartition(F.col(label), F.col("__block"))
    first = F.col("__block") * DRAWS_PER_TASK
    last = F.least(first + DRAWS_PER_TASK, F.col("target")) - 1
    each = blocks.select(label, "n", F.explode(F.sequence(first, last)).alias("__j"))
    h = key_hash(F.concat(F.col(label).cast("string"), F.lit(":"), F.col("__j").cast("string")), seed)
    return (
        each.withColumn("row_idx", F.pmod(hash_bucket(h, 12), F.col("n")))
        .groupBy(label, "row_idx").agg(F.count(F.lit(1)).alias("copies"))
        .hint("merge")
    )


def resample(df: DataFrame, key: str | Column, label: str, policy: str = "minority", seed: int = 42) -> DataFrame:
    """Bootstrap every class that has a target to exactly that size; adds ``copies``.

    One row per distinct row with its multiplicity, which is the form to
    aggregate or to weight; ``expand`` turns it into repeated rows.
    """
    plan = targets(df, label, policy)
    drawn = draws(plan, label, seed).select(
        F.col(label).alias("__l"), F.col("row_idx").alias("__i"), "copies")
    resized = plan.select(F.col(label).alias("__pl"), "target")
    kept = df.join(resized, F.col(label) == F.col("__pl")).drop("__pl")
    # Classes without a target pass through a filter; only the others are numbered.
    rows = numbered(kept.filter("target is not null"), key, label, seed)
    hit = rows.join(drawn, (F.col(label) == F.col("__l")) & (F.col("row_idx") == F.col("__i")))
    same = kept.filter("target is null").withColumn("copies", F.lit(1).cast("bigint"))
    return hit.select(*df.columns, "copies").unionByName(same.select(*df.columns, "copies"))


def expand(df: DataFrame) -> DataFrame:
    """Repeat each row ``copies`` times."""
    n = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return df.filter("copies > 0").withColumn("__c", n).drop("__c", "copies")


def resample_poisson(df: DataFrame, key: str | Column, label: str, policy: str = "minority",
                     seed: int = 42) -> DataFrame:
    """Same targets in expectation without moving a row.

    Every row draws its own multiplicity from Poisson(target / n_c) by inverse
    distribution of a hashed uniform; only the per-class table is joined.
    """
    plan = targets(df, label, policy).select(
        F.col(label).alias("__l"), F.try_divide(F.col("target"), F.col("n")).alias("__rate"))
    # A large rate is the sum of independent draws of at most MOST_RATE each, where exp(-rate) keeps its precision.
    parts = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("__rate") / MOST_RATE))
    joined = df.withColumn("__key", as_col(key).cast("string")).join(plan, F.col(label) == F.col("__l")) \
        .withColumn("__share", F.col("__rate") / parts)
    # Terms beyond rate + 12*sqrt(rate) + 12 have less probability than 2**-32.
    top = F.ceil(F.col("__share") + 12 * F.sqrt("__share") + 12)
    zero = F.lit(0).cast("bigint")

    def draw(part: Column) -> Column:
        name = F.when(part == 0, F.col("__key")).otherwise(F.concat(F.col("__key"), F.lit("#"), part.cast("string")))
        u = hash_uniform(key_hash(name, seed))
        start = F.struct(F.exp(-F.col("__share")).alias("p"), F.exp(-F.col("__share")).alias("cdf"), zero.alias("k"), u.alias("u"))
        return F.aggregate(
            F.sequence(F.lit(1).cast("bigint"), top), start,
            lambda a, i: F.struct(
                (a["p"] * F.col("__share") / i).alias("p"),
                (a["cdf"] + a["p"] * F.col("__share") / i).alias("cdf"),
                (a["k"] + (a["u"] >= a["cdf"]).cast("bigint")).alias("k"), a["u"].alias("u")),
            lambda a: a["k"])

    drawn = F.aggregate(F.sequence(zero, parts - 1), zero, lambda total, part: total + draw(part))
    copies = F.when(F.col("__rate").isNull(), F.lit(1).cast("bigint")).otherwise(drawn)
    return joined.withColumn("copies", copies).drop("__key", "__share", "__l", "__rate").filter("copies > 0")
