"""Corpus preparation: raw documents to token files, each stage on what the one before kept.

toxicity -> n-gram Jaccard join -> benchmark decontamination -> mixing -> token files.
All stages but the last return the columns of ``documents``; the last returns one row
per document of the mix, read back from the files.

Stages return lazy tables that carry whole texts through Python tasks, so each sets the
session's Arrow batches to ``BATCH_BYTES`` and leaves them so: the setting has to hold when
the table is written.  ``run`` puts the session's own setting back at its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import decontaminate, jaccard, mixing, tokenfile, toxicity
from flowlens.session import materialize


BATCHES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7; decided row by row, in the scan that scores."""
    spark.conf.set(BATCHES, BATCH_BYTES)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.below(docs, model, 0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return jaccard.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that quotes a benchmark item."""
    spark.conf.set(BATCHES, BATCH_BYTES)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the weighted mix, repeated as often as they are taken."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; doc_id, start, n_tokens, ids_crc32 as read back from them."""
    import public_tokenizers

    return tokenfile.read(tokenfile.write(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: Learned weights, hashes and token ids have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage reads what the one before wrote."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(BATCHES)
    try:
        for name, stage in STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != STAGES[-1][0]:
                docs = materialize(docs, f"pipeline-{name}")
    finally:
        spark.conf.set(BATCHES, before)
    return docs
