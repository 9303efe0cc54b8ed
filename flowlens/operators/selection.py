"""Feature scoring and selection.

Every scorer reduces the flow table to a small table of per-feature sums first
and finishes there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens import fixed_values as fv
from flowlens.functions.lookup import literal_table
from flowlens.session import materialize


def anova_f(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One-way ANOVA F per feature from count, mean and variance per class."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in features:
        x = F.col(f).cast("double")
        aggs += [F.avg(x).alias(f"{f}__m"), F.var_pop(x).alias(f"{f}__v")]
    per_class = df.groupBy(label).agg(*aggs)
    long = per_class.select("n", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}__m").alias("m"), F.col(f"{f}__v").alias("v"))
        for f in features])))
    w = Window.partitionBy("feature")  # one row per class
    centred = long.withColumn("d", F.col("m") - F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    n, k = F.sum("n"), F.count(F.lit(1))
    between = F.sum(F.col("n") * F.col("d") * F.col("d")) / (k - 1)
    within = F.sum(F.col("n") * F.col("v")) / (n - k)
    return centred.groupBy("feature").agg(F.try_divide(between, within).alias("f_score"))


def correlations(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Absolute Pearson correlation with the label index; undefined ones are left out."""
    one = df.agg(*[F.abs(F.corr(F.col(f).cast("double"), F.col(label).cast("double"))).alias(f) for f in features])
    return one.unpivot([], features, "feature", "corr").filter("corr is not null and not isnan(corr)")


def bin_edges(df: DataFrame, features: list[str], bins: int, error: float = 0.001) -> dict[str, list[float]]:
    """Distinct quantile edges per feature: ``bins`` numbers each, whatever the input size."""
    probs = [i / bins for i in range(1, bins)]
    numeric = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    edges = numeric.approxQuantile(features, probs, error)
    return {f: sorted(set(e)) for f, e in zip(features, edges)}


def equal_width_edges(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Edges at equal steps between minimum and maximum, from one aggregate."""
    row = df.agg(*[F.struct(F.min(F.col(f).cast("double")).alias("lo"), F.max(F.col(f).cast("double")).alias("hi")).alias(f)
                   for f in features]).first()
    return {f: sorted({row[f]["lo"] + (row[f]["hi"] - row[f]["lo"]) * i / bins for i in range(1, bins)})
            for f in features}


def _edges_below(x: Column, edges: list[float], offset: int = 0) -> Column:
    """Number of sorted edges below ``x`` as a balanced CASE: log2(edges) comparisons per row."""
    if not edges:
        return F.lit(offset)
    mid = len(edges) // 2
    return F.when(x > F.lit(float(edges[mid])), _edges_below(x, edges[mid + 1:], offset + mid + 1)).otherwise(
        _edges_below(x, edges[:mid], offset))


def binned_counts(df: DataFrame, edges: dict[str, list[float]], label: str) -> DataFrame:
    """``(feature, bin, label, n)``: contingency of every feature in one pass.

    ``bin`` is the number of edges below the value.  All bins of a row are
    packed into small integer codes; the partial aggregate shrinks them to
    bins x classes before the shuffle.
    """
    names = list(edges)
    width = max(len(e) for e in edges.values()) + 1
    codes = [F.lit(i * width) + F.coalesce(_edges_below(F.col(f).cast("double"), edges[f]), F.lit(0))
             for i, f in enumerate(names)]
    counts = df.select(F.col(label).alias("label"), F.explode(F.array(*codes)).alias("__code")).groupBy(
        "__code", "label").agg(F.count(F.lit(1)).alias("n"))
    name = F.get(F.array(*[F.lit(n) for n in names]), F.floor(F.col("__code") / width).cast("int"))
    return counts.select(name.alias("feature"), (F.col("__code") % width).alias("bin"), "label", "n")


def mutual_information(counts: DataFrame) -> DataFrame:
    """Σ p log(p / (p_bin · p_label)) per feature, in nats."""
    by = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    t = counts.withColumns({"__t": by("feature"), "__b": by("feature", "bin"), "__l": by("feature", "label")})
    n = F.col("n").cast("double")
    term = n / F.col("__t") * F.log(n * F.col("__t") / (F.col("__b") * F.col("__l")))
    return t.groupBy("feature").agg(F.sum(term).alias("mi"))


def split_table(counts: DataFrame) -> DataFrame:
    """``(feature, cut, label, n_left, n_right)`` for the split bin <= cut.

    The contingency table (features x bins x classes rows) is written once, so
    the flows are scanned once; the cumulative sums run over the bins of one
    (feature, label).
    """
    counts = materialize(counts, "bins")
    bins = counts.select("feature", "bin").distinct()
    labels = counts.select("feature", "label").distinct()
    grid = bins.join(labels, "feature")  # bins x classes of one feature
    full = grid.join(counts, ["feature", "bin", "label"], "left").fillna(0, ["n"])
    w = Window.partitionBy("feature", "label")
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return full.withColumns({"n_left": F.sum("n").over(run), "__all": F.sum("n").over(w)}).select(
        "feature", F.col("bin").alias("cut"), "label", "n_left", (F.col("__all") - F.col("n_left")).alias("n_right"))


def value_split_table(df: DataFrame, feature: str, label: str) -> DataFrame:
    """Equality splits of a categorical feature in the same layout."""
    counts = df.groupBy(F.col(feature).alias("cut"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("all"))
    # One entry per class, injected into every distinct value as an array.
    classes = totals.agg(F.collect_list(F.struct("label", "all")).alias("c")).scalar()
    grid = counts.select("cut").distinct().select("cut", F.inline(classes))
    return grid.join(counts, ["cut", "label"], "left").fillna(0, ["n"]).select(
        F.lit(feature).alias("feature"), "cut", "label", F.col("n").alias("n_left"),
        (F.col("all") - F.col("n")).alias("n_right"))


def _entropy(n: Column, total: Column) -> Column:
    p = n / total
    return -F.sum(F.when(total > 0, p * F.log2(p + 1e-10)).otherwise(0.0))


def split_quality(splits: DataFrame) -> DataFrame:
    """Gain, Gini, purity, class counts and sizes of every split."""
    w = Window.partitionBy("feature", "cut")
    t = splits.withColumns({"nl": F.sum("n_left").over(w), "nr": F.sum("n_right").over(w)})
    l, r = F.col("n_left").cast("double"), F.col("n_right").cast("double")
    nl, nr = F.col("nl").cast("double"), F.col("nr").cast("double")
    square = lambda n, total: F.coalesce(1 - F.sum(F.try_divide(n, total) * F.try_divide(n, total)), F.lit(0.0))
    out = t.groupBy("feature", "cut").agg(
        F.first("nl").alias("n_left"), F.first("nr").alias("n_right"),
        _entropy(l + r, nl + nr).alias("h"), _entropy(l, nl).alias("hl"), _entropy(r, nr).alias("hr"),
        square(l, nl).alias("gl"), square(r, nr).alias("gr"),
        F.count_if(l > 0).alias("classes_left"), F.count_if(r > 0).alias("classes_right"),
        F.max(F.try_divide(l + r, nl + nr)).alias("purity"), F.coalesce(F.max(F.try_divide(l, nl)), F.lit(0.0)).alias("purity_left"),
        F.coalesce(F.max(F.try_divide(r, nr)), F.lit(0.0)).alias("purity_right"))
    n = F.col("n_left") + F.col("n_right")
    mixed = lambda a, b: F.col("n_left") / n * a + F.col("n_right") / n * b
    return out.withColumns({
        "gain": F.col("h") - mixed(F.col("hl"), F.col("hr")),
        "weighted_gini": mixed(F.col("gl"), F.col("gr")),
        "balance": F.least("n_left", "n_right") / F.greatest("n_left", "n_right"),
    }).drop("h", "hl", "hr", "gl", "gr")


def information_gain(quality: DataFrame) -> DataFrame:
    """Best gain per feature over splits with rows on both sides, at least 0."""
    usable = F.when((F.col("n_left") > 0) & (F.col("n_right") > 0), F.col("gain"))
    return quality.groupBy("feature").agg(F.greatest(F.lit(0.0), F.coalesce(F.max(usable), F.lit(0.0))).alias("gain"))


def _any_word(name: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(name), F.lit(w)) for w in words])


def split_scores(quality: DataFrame) -> DataFrame:
    """Alternative scores of every split: diversity/balance/purity, domain bonus, gain minus Gini."""
    two_l, two_r, b, g = F.col("classes_left") > 1, F.col("classes_right") > 1, F.col("balance"), F.col("gain")
    diversity = F.when(two_l & two_r, 1.3).when(two_l | two_r, 1.1).otherwise(1.0)
    balance = F.when(b > 0.2, 1.2).when(b > 0.1, 1.0).otherwise(0.8)
    mean_purity = (F.col("purity_left") + F.col("purity_right")) / 2
    purity = F.when(mean_purity > F.col("purity"), (mean_purity - F.col("purity")) * 2).otherwise(0.0)
    improved = F.when(g <= 0, 0.0).otherwise(F.greatest(g * diversity * balance + purity, F.lit(0.0001)))
    name = F.col("feature")
    bonus = (
        F.when(name.isin(fv.DOMAIN_FEATURES), 1.3).otherwise(1.0)
        * F.when(_any_word(name, ["packet", "flow", "duration", "rate"]), 1.2).otherwise(1.0)
        * F.when(_any_word(name, ["flag"]), 1.4).otherwise(1.0)
        * F.when(b < 0.1, 0.3).when(b < 0.2, 0.7).otherwise(1.0))
    spread = F.when(two_l & two_r, 1.5).when(two_l | two_r, 1.2).otherwise(1.0)
    return quality.filter((F.col("n_left") > 0) & (F.col("n_right") > 0)).withColumns({
        "improved_score": improved, "domain_score": g * bonus * spread,
        "combined_score": g - F.col("weighted_gini") * 0.1})


def domain_bonus(scores: DataFrame, column: str, out: str = "importance") -> DataFrame:
    """Multiply scores by what the feature's name says about its domain."""
    name = F.col("feature")
    domain = name.isin(fv.DOMAIN_FEATURES)
    factor = F.when(~domain, 1.0)
    for words, f in fv.DOMAIN_BONUS:
        factor = factor.when(_any_word(name, words), f) if words else factor.otherwise(f)
    for words, f in fv.NAME_BONUS:
        factor = factor * F.when(_any_word(name, words), f).otherwise(1.0)
    return scores.withColumn(out, F.col(column) * factor)


def top_k(scores: DataFrame, column: str, k: int) -> DataFrame:
    """The k best features; scores equal to six digits are ties and go by name.

    Features that are multiples of each other have equal scores up to rounding
    noise, which must not decide the order.
    """
    return scores.orderBy(F.desc(F.round(column, 6)), "feature").limit(k)


def quota_selection(scores: DataFrame, column: str, n: int) -> DataFrame:
    """Top-n with up to half the places for domain features.

    A domain feature beyond the quota competes for the remaining places.
    The score table has one row per feature.
    """
    domain = F.col("feature").isin(fv.DOMAIN_FEATURES)
    order = [F.desc(column), F.col("feature")]
    w = Window.partitionBy(domain).orderBy(*order)
    marked = scores.withColumn("domain", domain).withColumn("__r", F.row_number().over(w))
    quota = n // 2
    reserved = marked.withColumn("reserved", F.col("domain") & (F.col("__r") <= quota))
    # Walk in score order: the k-th candidate outside the quota is taken while
    # (quota places filled so far) + (others so far) stays below n.
    walk = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.sum(F.col("reserved").cast("int")).over(walk)
    others = F.sum((~F.col("reserved")).cast("int")).over(walk)
    taken = F.col("reserved") | (filled + others <= n)
    return reserved.withColumn("__take", taken).filter("__take").select("feature", column, "domain", "reserved")


def combined_tree_score(mi: DataFrame, rf: DataFrame, f: DataFrame, k: int) -> DataFrame:
    """MI/max + forest importance + F/max; MI and F count only for their own top k."""
    def scaled(scores: DataFrame, c: str) -> DataFrame:
        top = scores.agg(F.struct(F.max(c).alias("m")).alias("s")).scalar()["m"]
        return top_k(scores, c, k).select("feature", (F.col(c) / top).alias(c))

    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rf.join(scaled(mi, "mi"), "feature", "left").join(scaled(f, "f_score"), "feature", "left").select(
        "feature", (zero(F.col("mi")) + F.col("importance") + zero(F.col("f_score"))).alias("score"))


def combined_linear_score(f: DataFrame, rfe: list[str], corr: DataFrame, k: int) -> DataFrame:
    """1 for the top-k F scores, 1 for surviving elimination, 0.5 for the top-k/3 correlations."""
    spark = f.sparkSession
    parts = top_k(f, "f_score", k).select("feature", F.lit(1.0).alias("w")).unionByName(
        top_k(corr, "corr", k // 3).select("feature", F.lit(0.5).alias("w")))
    if rfe:
        parts = parts.unionByName(literal_table(spark, ["feature", "w"], [(x, 1.0) for x in rfe]))
    return parts.groupBy("feature").agg(F.sum("w").alias("score"))


def selection_union(*selections: DataFrame) -> DataFrame:
    """Distinct union of selected feature sets."""
    return reduce(lambda a, b: a.union(b), [s.select("feature") for s in selections]).distinct()


def selection_summary(selections: dict[str, DataFrame]) -> DataFrame:
    """Features selected per method and in total."""
    parts = [d.select(F.lit(m).alias("method"), "feature") for m, d in selections.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("method").agg(
        F.count(F.lit(1)).alias("n_features"), F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("features"))
