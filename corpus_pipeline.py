"""A training corpus from the documents table, in five stages.

Each stage takes what its predecessor kept; between stages the documents are
written as Parquet and read again, so a lost executor costs a stage at most.

The stages share Python workers, which hold on to the most that any of them took.
So each stage has Spark hand over texts in batches of about ``BATCH_BYTES`` (a
setting of the session; ``run`` puts the former one back), and the encoder of the
last one remembers fewer words than ``op4_token_files`` does. Neither changes rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontamination, mixing, simhash, token_files, toxicity
from tallyloom.llm.common import documents, new_path, table, written

#: Bytes of the batches that Python workers get, about; a longer document has a batch of its own.
BATCH_BYTES = 4 << 20
#: Words whose ids the encoder remembers.
ENCODER_WORDS = 250_000
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    """The stage, in a session that hands over batches of BATCH_BYTES; its plan may run after it returns, so the setting stays."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is 0.3 or more."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.below(docs, model, toxicity.THRESHOLD)


@small_batches
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group of SimHash near copies."""
    return simhash.representatives(docs)


@small_batches
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a benchmark item contaminates."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


@small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked marginals of source, language and topic."""
    return mixing.sampled(docs)


@small_batches
def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all that's left, read from the token files just written."""
    where = new_path(spark, "corpus-tokens")
    return token_files.digests(token_files.write_tokens(docs, where, words=ENCODER_WORDS), where)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
    ("token_files", to_token_files),
]

#: SQL can't train the classifier, nor link fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), spark.conf.get(_BATCHES)
    try:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    finally:
        spark.conf.set(_BATCHES, before)
    return docs
