"""A corpus pipeline of five stages over ``documents``; each stage works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet under the
shared folder and reads again for the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import langid, line_dedup, minhash, mixing, pieces
from sluice.llm._common import Scratch, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a determined language stay."""
    return langid.keep_identified(spark, docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; documents of which nothing is left go with them."""
    return line_dedup.without_repeats(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.expand(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether decoding gives its text back."""
    return pieces.encoded(spark, docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_near),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: No SQL form: the first stage is a trained model. Tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, last = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs
