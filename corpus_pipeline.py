"""A training corpus from raw documents: filter, deduplicate, mask, mix, tokenise.

``run`` applies the stages to ``documents``; each one's result is written as
parquet to the shared folder and read again, so a later stage never recomputes
an earlier one.

Defined results: null and empty texts are not toxic, are near-duplicates of each
other, hold no secret and are never taken into the mix; rows with a null id stay
rows of their own; of equal rows one stays before mixing; rows with one id but
different texts are separate documents; very long texts are processed whole; an
empty table gives no rows; columns beside those of ``documents`` are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, mixing, secrets, simhash, toxicity
from tallyloom.scratch import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE, MAX_BITS = 4, 4
RANKS = "byte_bpe_50k.tiktoken"


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels beside the documents."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
    return toxicity.scored(docs, model, keep=COLUMNS).filter("score < 0.5").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate component: the smallest id (null ids last), and one of equal rows."""
    return simhash.representatives(docs.select(*COLUMNS), SHINGLE, MAX_BITS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with every secret masked; n_chars follows the text."""
    return secrets.masked(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as their source's target asks for."""
    return mixing.mix(docs.select(*COLUMNS))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return bpe.encoded(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("toxicity", not_toxic),
    ("near-duplicates", one_of_each),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("bpe", tokenised),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
