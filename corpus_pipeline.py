"""A training corpus from raw documents: toxic documents go, near copies go, repeated passages go, sources
are mixed to their weights, and what is left becomes token ids. Each stage takes and (but for the last) gives
the columns of `documents`; between stages the rows are written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm import bpe, common, mixing, simhash, substrings, toxicity

#: SQL cannot express the trained classifier, the near copies or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on the labelled ones scores below 0.5. Null and empty texts score by the share
    of toxic labels; repeated rows go or stay together; further columns stay, whatever their names."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = "_toxicity"
    while out in docs.columns:
        out += "_"
    return toxicity.score(docs, model, out=out).where(F.col(out) < 0.5).drop(out)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id. Texts without words are copies of each
    other; rows without an id stay."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; a document that loses all its words stays, empty. Rows
    without an id come first."""
    return substrings.cleaned(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of documents, so often and so many that sources have their target sizes. Texts without words are never
    taken; a null source is a source; exact repetitions are rows like any other."""
    return mixing.Mix(docs).documents()


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of each run; null and empty texts have no ids. Workers keep small tables, as they have
    served other stages too."""
    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, states=15_000, pieces=40_000)
    return ids.withColumn("n_tokens", F.size("ids"))


def _bounded(stage):
    """The stage with Arrow batches of bounded size."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _bounded(drop_toxic)),
    ("simhash_near_dedup", _bounded(drop_near_copies)),
    ("substring_dedup", _bounded(cut_repeats)),
    ("mixing", _bounded(mix_sources)),
    ("bpe", _bounded(encode)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialize(docs, f"stage-{name}")
    return docs
