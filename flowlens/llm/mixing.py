"""Mixing sources to target weights by Pareto order sampling.

The words of all sources are shared out by weight; a source's target stops at
``MOST`` times its own words and the excess is shared again by weight.  Inside a
source the expected number of copies of a document is ``rate x moderation``, at
most ``MOST``: documents beyond ``LONG`` words get less the longer they are, by
powers of a half, so no few huge texts fill a source, and the rate makes up for it.

The whole part of the expected copies is taken for certain.  The fraction is a
Pareto order sample: with u uniform by document and p the fraction, documents rank
by ``(u / (1 - u)) / (p / (1 - p))`` and are taken in that order until the source's
remaining words are used up, the last one if at least half of it fits.

What decides is one small table per (source, length level): certain copies,
fraction and the ranking value at the cut.  It comes from counts (sources, levels,
65,536 ranking buckets) and from the rows of one boundary bucket per source, so no
source is ever ranked in one task; then every document decides by itself, in its
own row, without a shuffle of texts.

Defined results: null texts have size 0; documents of size 0 take no words (0 or more
copies without effect: none are made); a null source is a source, after the others; a
source without words has target 0; rows that repeat a doc_id share one random number,
so they are taken or left together when they meet the cut; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import uniform
from flowlens.session import materialize

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3.0
LONG = 1024
BUCKETS = 65_536
SEED = 20_011


def words(text: str = "text"):
    """Number of runs of anything but space, tab, line feed, VT, FF and CR."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def level(size: str = "size"):
    """0 up to LONG words, then one more for each doubling."""
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.col(size), F.lit(1)) / F.lit(float(LONG))))).cast("int")


def targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size): one row per source throughout.

    With the sources in ascending order of ``most x size / weight``, those before
    some place stop at their limit and the rest share what is left by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = by_source.withColumn("weight", pick).withColumn("limit", F.lit(most) * F.col("source_size"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    share = left / F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    shared = ranked.withColumn("_share", share).withColumn("_fits", F.col("_share") * F.col("weight") <= F.col("limit"))
    level_off = F.coalesce(F.min(F.when(F.col("_fits"), F.struct(F.col("limit") / F.col("weight"), "_share")))
                           .over(everything)["_share"], F.lit(float("inf")))
    return shared.withColumn("target", F.least("limit", F.when(F.col("limit") > 0, level_off * F.col("weight")).otherwise(0.0))) \
        .select("source", "source_size", "target")


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """One row per (source, length level): source_size, target, certain, fraction and the cut."""
    sized = materialize(docs.select(
        "source", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), words().alias("size"),
    ).withColumn("level", level()), "mix-sizes")
    by_level = materialize(sized.groupBy("source", "level").agg(F.sum("size").alias("words")), "mix-levels")
    by_source = targets(by_level.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)

    moderation = F.pow(F.lit(0.5), F.col("level") / 2)
    levels = by_level.join(by_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    own = Window.partitionBy("source").orderBy(F.col("level").asc())
    capped = F.coalesce(F.sum(F.lit(most) * F.col("words")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum(moderation * F.col("words")).over(own.rowsBetween(0, Window.unboundedFollowing))
    rates = levels.withColumn("_rate", F.when(open_ > 0, (F.col("target") - capped) / open_).otherwise(0.0)) \
        .withColumn("_fits", F.col("_rate") * moderation <= most)
    rate = F.coalesce(F.min(F.when(F.col("_fits"), F.struct("level", "_rate"))).over(Window.partitionBy("source"))["_rate"],
                      F.lit(float("inf")))
    copies = F.least(F.lit(most), F.greatest(F.lit(0.0), rate * moderation))
    shares = rates.withColumn("copies", F.round(copies, 9)).withColumn("certain", F.floor("copies").cast("int")) \
        .withColumn("fraction", F.col("copies") - F.col("certain"))
    rest = F.col("target") - F.sum(F.col("certain") * F.col("words")).over(Window.partitionBy("source"))
    shares = materialize(shares.select("source", "level", "source_size", "target", "certain", "fraction",
                                       F.greatest(rest, F.lit(0.0)).alias("rest")), "mix-shares")

    ranked = _join(sized, shares).withColumn("rank", rank_value("id", "fraction", seed)).filter((F.col("fraction") > 0) & (F.col("size") > 0)) \
        .withColumn("bucket", F.floor(F.col("rank") * BUCKETS).cast("int")).select("source", "id", "size", "rank", "bucket", "rest")
    filled = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    edge = filled.withColumn("_upto", upto).filter((F.col("_upto") > F.col("rest")) & (F.col("_upto") - F.col("words") <= F.col("rest"))) \
        .groupBy("source").agg(F.min(F.struct("bucket", (F.col("_upto") - F.col("words")).alias("before"))).alias("e"))
    edges = materialize(edge.select(F.col("source").alias("_s"), "e.*"), "mix-edges").withColumnRenamed("bucket", "_b")
    at_edge = ranked.join(edges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    in_bucket = Window.partitionBy("source").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, -1)
    fits = F.col("before") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0)) + F.col("size") / 2 <= F.col("rest")
    last = at_edge.withColumn("_fits", fits).groupBy("source").agg(
        F.max(F.when(F.col("_fits"), F.struct("rank", "id"))).alias("_last")).withColumnRenamed("source", "_t")
    cuts = edges.join(last, F.col("_s").eqNullSafe(F.col("_t")), "left").select(
        "_s", F.coalesce(F.col("_last.rank"), F.col("_b") / F.lit(float(BUCKETS))).alias("cut_rank"),
        F.coalesce(F.col("_last.id"), F.lit(-(2**63))).alias("cut_id"))
    return materialize(
        shares.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "rest")
        .fillna({"cut_rank": 2.0, "cut_id": 0}), "mix-plan")


def rank_value(id_column: str, fraction: str, seed: int):
    """The Pareto ranking value q as q / (1 + q), which has the same order and lies in [0, 1)."""
    u, p = uniform(id_column, seed=seed), F.col(fraction)
    up, down = u * (1 - p), (1 - u) * p
    return F.when(p > 0, F.least(up / (up + down), F.lit(1.0 - 2.0**-53))).otherwise(1.0)


def _join(rows: DataFrame, plan_rows: DataFrame) -> DataFrame:
    named = plan_rows.withColumnsRenamed({"source": "_plan_source", "level": "_plan_level"})
    same = F.col("source").eqNullSafe(F.col("_plan_source")) & (F.col("level") == F.col("_plan_level"))
    return rows.join(named, same).drop("_plan_source", "_plan_level")


def decided(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(row, mix): each document as a struct, and its size, source_size, target and copies."""
    facts = plan(docs.select("doc_id", "source", "text"), weights, most, seed)
    packed = facts.select(F.col("source").alias("s"), F.col("level").alias("l"), F.struct("*").alias("p"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("size", words("row.text")) \
        .withColumn("id", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(2**63))))
    rows = rows.join(packed, F.col("row.source").eqNullSafe(F.col("s")) & (level() == F.col("l")))
    value = rank_value("id", "p.fraction", seed)
    extra = (F.col("p.fraction") > 0) & (F.struct(value, F.col("id")) <= F.struct(F.col("p.cut_rank"), F.col("p.cut_id")))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("p.certain") + extra.cast("int"))
    return rows.select("row", F.struct("size", "p.source_size", "p.target", copies.alias("copies")).alias("mix"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each row as often as it is taken."""
    rows = decided(docs, **options).filter(F.col("mix.copies") > 0)
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("mix.copies")))).select("row.*")


def summary(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    return decided(docs.select("doc_id", "source", "text"), **options).select(
        "row.doc_id", "mix.size", "mix.source_size", "mix.target",
        (F.col("mix.copies") * F.col("mix.size")).cast("long").alias("taken"))
