"""The pipeline's stages: right columns, decisions that take effect, clean documents kept."""

import corpus_pipeline
import helpers as h
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SMALL).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def ids(frame):
    return [r["doc_id"] for r in frame.select("doc_id").collect()]


def test_columns_and_order(kept):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "decontamination", "mixing", "token_files"]
    for name in names[:-1]:
        assert kept[name].dtypes == kept["start"].dtypes


def test_join_keeps_one_of_each_group(kept):
    before = [(r["doc_id"], r["text"]) for r in kept["toxicity"].collect()]
    want = {i for i, _, c, _ in h.join_by_hand(before) if i == c}
    assert sorted(ids(kept["ngram_jaccard_join"])) == sorted(want)


def test_decontamination_drops_quotes_only(spark, kept):
    items = [r["text"].lower() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"].lower() for r in kept["ngram_jaccard_join"].collect()}
    want = {i for i, t in before.items() if not any(x in t for x in items)}
    assert set(ids(kept["decontamination"])) == want


def test_mix_and_tokens_cover_the_same_rows(kept):
    assert sorted(ids(kept["token_files"])) == sorted(ids(kept["mixing"]))
    rows = kept["token_files"].orderBy("start").collect()
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]


def test_run_equals_the_stages(spark, kept):
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(
        tuple(r) for r in kept["token_files"].collect())
