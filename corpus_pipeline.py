"""A training-data pipeline: the stages a corpus passes, each applied to what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every result as
Parquet in the shared folder and reads it back as the next stage's documents, so a stage never
depends on executors that may be gone.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopanel.cluster import set_shared_folder, stored
from canopanel.llm import exact_dedup, language, mixing, near, packing


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without letters go, whichever language is likely and by how much.

    A clean text may be in several languages, so a low probability is no reason to drop it.
    """
    tagger = language.train(docs)
    found = language.identify(docs, tagger, lang_col="_lang_pred", score_col="_lang_score")
    pred = found.columns[-2]
    return found.where(F.col(pred) != language.UNDETERMINED).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, similarity 0.8) the one with the smallest id."""
    return near.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks: shares as the square root of characters."""
    return mixing.mix_sources(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


def _stage(work):
    """A stage, in a session that has a shared folder: its own, or one made for a local session."""
    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        set_shared_folder(spark)
        return work(spark, docs, sf_dir)
    return stage


STAGES = [
    ("language_id", _stage(identify_language)), ("exact_dedup", _stage(drop_copies)),
    ("near_dedup", _stage(drop_near_copies)), ("mix_sources", _stage(mix)), ("packing", _stage(pack))]

# A trained network and a tokenizer decide; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    set_shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
