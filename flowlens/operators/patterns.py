"""Signature scans over any text column.

``scan_patterns`` takes a pattern table and routes by its size: up to ``WIDE_LIMIT``
patterns are compiled to expressions on the text (no join, no row growth).  Beyond
that positions that may hold a pattern are found by a bitmap inside the row (``grams``),
joined with the patterns and verified in full, so the cost does not grow with the
number of patterns.  The list forms below are those expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.stats import over_all
from flowlens.functions.text import occurrences, quote, with_chunks
from flowlens.operators import grams as gr
from flowlens.session import materialize

WIDE_LIMIT = 150


def presence(df: DataFrame, text_col: str, patterns: list[str], lower: bool = False) -> DataFrame:
    """One 0/1 column ``aca_binary_<i>`` per pattern."""
    text = F.lower(text_col) if lower else F.col(text_col)
    return df.withColumns({
        f"aca_binary_{i}": F.coalesce(F.contains(text, F.lit(p)), F.lit(False)).cast("int")
        for i, p in enumerate(patterns)})


def matching_patterns(df: DataFrame, text_col: str, patterns: list[str]) -> DataFrame:
    """One row per (row, contained pattern).

    The fixed list is filtered inside the row, so only hits are produced.
    """
    listed = F.array(*[F.struct(F.lit(i).alias("pattern_id"), F.lit(p).alias("pattern"))
                       for i, p in enumerate(patterns)])
    hits = F.filter(listed, lambda p: F.contains(F.col(text_col), p["pattern"]))
    keep = [c for c in df.columns if c != text_col]
    return df.select(*keep, F.explode(hits).alias("__p")).select(*keep, "__p.pattern_id", "__p.pattern")


def counts(df: DataFrame, text_col: str, patterns: list[str]) -> DataFrame:
    """Overlap-aware occurrence counts ``aca_count_<i>``."""
    return df.withColumns({
        f"aca_count_{i}": F.coalesce(occurrences(F.col(text_col), p), F.lit(0))
        for i, p in enumerate(patterns)})


def _length(text_col: str) -> Column:
    return F.coalesce(F.length(text_col), F.lit(0))


def frequencies(df: DataFrame, text_col: str, patterns: list[str]) -> DataFrame:
    """Counts per character, ``aca_freq_<i>``; an empty text has frequency 0."""
    n = F.greatest(_length(text_col), F.lit(1))
    counted = counts(df, text_col, patterns)
    return counted.withColumns({f"aca_freq_{i}": F.col(f"aca_count_{i}") / n for i in range(len(patterns))})


def aggregates(df: DataFrame, text_col: str, patterns: list[str]) -> DataFrame:
    """Per-text totals: matches, distinct patterns, density, length."""
    listed = F.array(*[F.coalesce(occurrences(F.col(text_col), p), F.lit(0)) for p in patterns])
    return (
        df.withColumn("__counts", listed)
        .withColumns({
            "aca_total_matches": F.aggregate("__counts", F.lit(0), lambda a, x: a + x),
            "aca_unique_patterns": F.size(F.filter("__counts", lambda x: x > 0)),
            "aca_text_length": _length(text_col),
        })
        .withColumn("aca_match_density", F.col("aca_total_matches") / F.greatest("aca_text_length", F.lit(1)))
        .drop("__counts")
    )


def feature_names(n: int) -> list[str]:
    """Names of the full vector: binary, count, frequency, four aggregates."""
    return (
        [f"aca_binary_{i}" for i in range(n)] + [f"aca_count_{i}" for i in range(n)]
        + [f"aca_freq_{i}" for i in range(n)]
        + ["aca_total_matches", "aca_unique_patterns", "aca_match_density", "aca_text_length"]
    )


def feature_vector(df: DataFrame, text_col: str, patterns: list[str], out: str = "aca_features") -> DataFrame:
    """Array of the full feature vector, each pattern counted once."""
    n = F.greatest(_length(text_col), F.lit(1))
    listed = F.array(*[F.coalesce(occurrences(F.col(text_col), p), F.lit(0)).cast("double") for p in patterns])
    total = F.aggregate("__counts", F.lit(0.0), lambda a, x: a + x)
    unique = F.size(F.filter("__counts", lambda x: x > 0)).cast("double")
    vector = F.concat(
        F.transform("__counts", lambda x: (x > 0).cast("double")),
        F.col("__counts"),
        F.transform("__counts", lambda x: x / n),
        F.array(total, unique, total / n, _length(text_col).cast("double")),
    )
    return df.withColumn("__counts", listed).withColumn(out, vector).drop("__counts")


def positions(df: DataFrame, text_col: str, patterns: list[str]) -> DataFrame:
    """All occurrences: ``(start, end inclusive, pattern)``, 0-based, overlaps included.

    Inside a slice, splitting at a zero-width look-ahead cuts the slice just
    before every occurrence; running lengths of the pieces are the positions.
    """
    longest = max(len(p) for p in patterns)
    chunks = with_chunks(df, text_col, overlap=longest - 1)
    keep = [c for c in df.columns if c != text_col]

    def starts(p: str) -> Column:
        pieces = F.split(F.col("chunk"), f"(?={quote(p)})")
        lengths = F.transform(pieces, lambda x: F.length(x))
        walk = F.aggregate(
            lengths,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
            lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")),
            lambda a: a["all"])
        real = F.filter(walk, lambda s: (s < F.col("chunk_len")) & (
            (s > 0) | F.startswith(F.col("chunk"), F.lit(p))))
        return F.when(F.contains(F.col("chunk"), F.lit(p)), F.transform(real, lambda s: F.struct(
            (F.col("chunk_start") + s).alias("start"),
            (F.col("chunk_start") + s + (len(p) - 1)).alias("end"),
            F.lit(p).alias("pattern"))))

    found = F.flatten(F.array_compact(F.array(*[starts(p) for p in patterns])))
    return chunks.select(*keep, F.explode(found).alias("__m")).select(*keep, "__m.*")


def gram_matches(df: DataFrame, text_col: str, patterns: DataFrame) -> DataFrame:
    """``(start, end inclusive, pattern)`` for any number of patterns.

    Positions whose bytes may be a pattern's anchor are found inside the row; only they
    become rows, are joined with the anchors and compared in full.  An empty table matches nothing.
    """
    keep = [c for c in df.columns if c != text_col]
    listed = patterns.select("pattern").filter(F.length("pattern") > 0).distinct()
    table = materialize(gr.anchors(listed, gr.pair_counts(df, text_col)), "anchors")
    n, held, before, after = table.agg(
        F.count(F.lit(1)), F.sum(F.octet_length("body")), F.max("at"), F.max(F.octet_length("body") - F.col("at"))).first()
    if not n:
        return df.limit(0).select(*keep, F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"), F.lit("").alias("pattern"))
    found = gr.candidates(df, text_col, gr.bitmaps(table), before, after)
    known = table.select(*[F.col(c).alias(f"__{c}") for c in table.columns])
    if n <= gr.BROADCAST_PATTERNS and held <= gr.BROADCAST_BYTES:
        known = F.broadcast(known)
    # the pattern begins ``__at`` bytes before the anchor; ``front`` bytes of the text are at hand there
    whole = (F.col("__size") < gr.GRAM) | ((F.col("front") >= F.col("__at")) & (
        F.substring("around", (F.col("front") - F.col("__at") + 1).cast("int"), F.octet_length("__body")) == F.col("__body")))
    start = F.col("pos") - F.col("__lead")
    return found.join(known, (F.col("size") == F.col("__size")) & (F.col("gram") == F.col("__gram"))).filter(whole).select(
        *keep, start.alias("start"), (start + F.col("__chars") - 1).alias("end"), F.col("__pattern").alias("pattern"))


def scan_patterns(df: DataFrame, text_col: str, patterns: DataFrame, mode: str = "count", lower: bool = False) -> DataFrame:
    """Occurrences (overlapping ones included) of a pattern table in a text column.

    Every row of ``df`` is scanned for itself, whatever its other columns hold: rows that are
    alike or hold NULLs each have their results.  Modes: ``position`` (start, end, pattern),
    ``count`` (pattern, n), ``presence`` (pattern), ``frequency`` (pattern, occurrences per
    character), ``totals`` (one row per text: total_matches, unique_patterns,
    match_density, text_length).  ``lower`` folds text and patterns.

    Up to ``WIDE_LIMIT`` patterns are counted inside the row.  Beyond that, rows are
    written once with a number of their own, by which their matches come back to them.
    """
    if mode not in ("position", "count", "presence", "frequency", "totals"):
        raise ValueError(f"unknown mode {mode}")
    fold = F.lower if lower else (lambda c: c)
    keep = [c for c in df.columns if c != text_col]
    rows = df.select(*keep, fold(F.coalesce(F.col(text_col), F.lit(""))).alias("__text"))
    table = patterns.select(fold(F.col("pattern")).alias("pattern")).filter(F.length("pattern") > 0).distinct()
    some = [r["pattern"] for r in table.limit(WIDE_LIMIT + 1).collect()]
    wide = 0 < len(some) <= WIDE_LIMIT
    if mode == "position":
        return positions(rows, "__text", sorted(some)) if wide else gram_matches(rows, "__text", table)
    size = F.length("__text").alias("__size")
    if wide:
        listed = F.array(*[F.struct(F.lit(p).alias("pattern"), occurrences(F.col("__text"), p).cast("bigint").alias("n")) for p in sorted(some)])
        hits = rows.select(*keep, size, F.filter(listed, lambda p: p["n"] > 0).alias("__hits"))
    else:
        numbered = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "scan-rows")
        found = gram_matches(numbered.select("__row", "__text"), "__text", table).groupBy("__row", "pattern").agg(F.count(F.lit(1)).alias("n"))
        lists = found.groupBy("__row").agg(F.collect_list(F.struct("pattern", "n")).alias("__hits"))  # at most one entry per pattern
        none = F.array().cast("array<struct<pattern:string,n:bigint>>")
        hits = numbered.select(*keep, size, "__row").join(lists, "__row", "left").select(*keep, "__size", F.coalesce("__hits", none).alias("__hits"))
    if mode == "totals":
        total = F.aggregate("__hits", F.lit(0).cast("bigint"), lambda a, h: a + h["n"])
        return hits.select(*keep, total.alias("total_matches"), F.size("__hits").cast("bigint").alias("unique_patterns"),
                           (total / F.greatest("__size", F.lit(1))).alias("match_density"), F.col("__size").alias("text_length"))
    each = hits.select(*keep, "__size", F.explode("__hits").alias("__h")).select(*keep, "__size", "__h.pattern", "__h.n")
    if mode == "count":
        return each.drop("__size")
    if mode == "presence":
        return each.select(*keep, "pattern")
    return each.select(*keep, "pattern", (F.col("n") / F.col("__size")).alias("frequency"))


def pattern_statistics(df: DataFrame, text_col: str, patterns: list[str]) -> DataFrame:
    """Corpus totals per pattern: occurrences, texts hit, share of all occurrences."""
    listed = F.array(*[
        F.struct(F.lit(p).alias("pattern"), F.coalesce(occurrences(F.col(text_col), p), F.lit(0)).alias("n"))
        for p in patterns])
    per_pattern = df.select(F.inline(listed)).groupBy("pattern").agg(
        F.sum("n").alias("total_matches"), F.count_if(F.col("n") > 0).alias("texts_hit"))
    share = F.try_divide(F.col("total_matches"), over_all(F.sum("total_matches")))
    return per_pattern.withColumn("share", F.coalesce(share, F.lit(0.0)))


def pattern_scores(df: DataFrame, text_col: str, patterns: list[str], flags: bool = True,
                   max_score: Column | None = None) -> DataFrame:
    """Matches per text, scaled by the corpus maximum; high above 0.7."""
    counts_ = F.array(*[F.coalesce(occurrences(F.lower(text_col), p), F.lit(0)) for p in patterns])
    scored = df.withColumn("__counts", counts_).withColumn(
        "pattern_score", F.aggregate("__counts", F.lit(0), lambda a, x: a + x))
    if max_score is None:
        max_score = scored.agg(F.struct(F.max("pattern_score").alias("m")).alias("s")).scalar()["m"]
    out = scored.withColumns({
        "has_pattern_match": (F.col("pattern_score") > 0).cast("int"),
        "detection_score": F.when(max_score > 0, F.col("pattern_score") / max_score).otherwise(0.0),
    }).withColumn("high_pattern", F.col("detection_score") > 0.7)
    if flags:
        out = out.withColumns({f"pattern_{p}": (F.get("__counts", F.lit(i)) > 0).cast("int") for i, p in enumerate(patterns)})
    return out.drop("__counts")
