"""From ``documents`` to token counts in five stages, each a job over all its predecessor kept.

A stage is a function (spark, docs, sf_dir) -> DataFrame. Every result is written as
Parquet in the shared folder and read again as the next stage's documents; all but the last
have the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.llm import bpe, mixing, simhash, substring, toxicity
from hirelens.llm.common import coded, decoded, drop_staged, read, staged

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: A document goes if its toxicity is at least this.
TOXIC = 0.5
#: No stage can be written in SQL without the learned model of the first.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or toxicity is below TOXIC; learned from rows that are not held out.

    Every row goes or stays by its own text, also where rows share an id or have none.
    """
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), usable=~toxicity.held_out())
    rows, codes = coded(docs)                   # columns may have any names
    id_code, text = codes["doc_id"], codes["text"]
    scored = toxicity.score(rows, model, id_code, text, keep=[c for c in codes.values() if c not in (id_code, text)])
    return decoded(scored.where(F.col("score") < TOXIC), codes)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the smallest id."""
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one holds; n_chars follows the new text."""
    return substring.cut(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.expand(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every document of the mix."""
    return bpe.round_trip_digests(docs, RANKS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_staged(before)                     # no later stage reads it
    return docs
