"""Pattern scans against a plain search, in both forms, on rows that are alike, NULL or awkward."""

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowlens.operators import grams, patterns as pt

TEXTS = ["aaaa", "", None, "abab ébéb ébé", "the quick brown fox jumps over the lazy dog", "x" * 50, "fox fox", "日本語日本", "\x00a\x00", "AbC abc",
         "padding " * 40 + "a needle of many bytes" + " padding" * 40]
PATTERNS = ["a", "aa", "ab", "é", "ébé", "fox", "quick brown fox", "日本", "xxxxxxxxxx", "abc", "\x00", "a needle of many bytes", "not there", "needle of many bytes "]


def table(spark):
    rows = [(k // 2 if k % 3 else None, t, "same") for k, t in enumerate(TEXTS + TEXTS[:4])]
    return spark.createDataFrame(rows, "id int, text string, other string")


def by_hand(df, pats):
    out = []
    for r in df.collect():
        text = r["text"] or ""
        for p in pats:
            for at in range(len(text)):
                if p and text.startswith(p, at):
                    out.append((r["id"], at, at + len(p) - 1, p))
    return out


def pattern_table(spark, pats):
    return spark.createDataFrame([(p,) for p in [*pats, "", None, pats[0]]], "pattern string")


@pytest.mark.parametrize("limit", [150, 0])
def test_both_forms_equal_a_plain_search(spark, monkeypatch, limit):
    monkeypatch.setattr(pt, "WIDE_LIMIT", limit)
    df, pats = table(spark), pattern_table(spark, PATTERNS)
    found = by_hand(df, PATTERNS)
    got = pt.scan_patterns(df, "text", pats, "position")
    assert Counter((r["id"], r["start"], r["end"], r["pattern"]) for r in got.collect()) == Counter(found)
    rows = [(r["id"], r["text"] or "") for r in df.collect()]
    counts = Counter()
    totals = Counter()
    for i, text in rows:
        own = Counter(p for p in PATTERNS for at in range(len(text)) if text.startswith(p, at))
        counts.update((i, p, n) for p, n in own.items())
        totals[i, sum(own.values()), len(own), len(text)] += 1
    assert Counter(tuple(r) for r in pt.scan_patterns(df, "text", pats, "count").select("id", "pattern", "n").collect()) == counts
    assert Counter(tuple(r) for r in pt.scan_patterns(df, "text", pats, "totals").select(
        "id", "total_matches", "unique_patterns", "text_length").collect()) == totals
    seen = Counter((r["id"], r["pattern"]) for r in pt.scan_patterns(df, "text", pats, "presence").collect())
    assert seen == Counter((i, p) for (i, p, _), m in counts.items() for _ in range(m))
    share = pt.scan_patterns(df, "text", pats, "frequency")
    assert share.count() == sum(counts.values()) and share.agg(F.max("frequency")).first()[0] <= 1


def test_shuffled_anchors_and_small_runs(spark, monkeypatch):
    """Beyond the broadcast bound, and where a text spans several runs of bytes."""
    monkeypatch.setattr(grams, "BROADCAST_PATTERNS", 0)
    monkeypatch.setattr(grams, "RUN_BYTES", 7)
    df = table(spark)
    got = pt.gram_matches(df, "text", pattern_table(spark, PATTERNS))
    assert Counter((r["id"], r["start"], r["end"], r["pattern"]) for r in got.collect()) == Counter(by_hand(df, PATTERNS))


def test_many_patterns(spark):
    pats = ["".join(p) for p in itertools.product("abcdx", repeat=4)]
    df = spark.createDataFrame([(1, "abcdabcdxxxx" * 5), (2, "ddddd")], "id int, text string")
    got = pt.scan_patterns(df, "text", pattern_table(spark, pats), "count")
    assert got.filter("id = 2").select("n").first()["n"] == 2 and got.filter("id = 1").agg(F.sum("n")).first()[0] == 57


def test_empty_tables(spark):
    df = table(spark)
    none = spark.createDataFrame([], "pattern string")
    assert pt.gram_matches(df, "text", none).count() == 0
    assert pt.scan_patterns(df, "text", none, "totals").agg(F.sum("total_matches")).first()[0] == 0
    assert pt.gram_matches(df.limit(0), "text", pattern_table(spark, PATTERNS)).count() == 0


def test_no_row_per_character(spark):
    """Positions are filtered in the task: nothing is exploded."""
    plan = pt.gram_matches(table(spark), "text", pattern_table(spark, PATTERNS))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
