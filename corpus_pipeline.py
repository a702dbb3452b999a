"""A corpus pipeline over ``documents``: quality filter, near-duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of ``documents``. Null texts count as empty in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.llm import byte_bpe, mixing, quality_crf, simhash_dedup
from remitlens.llm.common import new_folder, table

#: Near-duplicates share four fifths or more of their five-word shingles. Of 256 fingerprint bits, such texts
#: differ in about 39 (the angle of a cosine of 8/9; up to 48 if they have a handful of shingles), with a standard
#: deviation of 6; the radius leaves over three of them, and the shingles themselves decide among the candidates.
SHINGLE, LANES, SIMILARITY, RADIUS = 5, 4, 0.8, 70


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field predicts to be good; it learns from labels that are not held out."""
    model = quality_crf.fit(docs.where(~quality_crf.held_out()), table(spark, sf_dir, "labels"))
    return quality_crf.score(docs, model, name="__score").where("__score >= 0.5").select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near-duplicates."""
    prints = simhash_dedup.fingerprints(docs, shingle=SHINGLE, lanes=LANES, distinct=True)
    return simhash_dedup.keep_one(docs, simhash_dedup.similar_groups(prints, docs, RADIUS, SIMILARITY, SHINGLE))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix by sources' weights takes them."""
    return mixing.apply(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document of the mix."""
    encoded = byte_bpe.encode_packed(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "round_trips")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: No SQL: the field, the fingerprints' tiles and the merges of the vocabulary are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; those before the last are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
