"""The registered queries of the ten operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.llm import byte_bpe, fingerprint, gru_lm, html_mincut, mixing, pivot_topk, quality_crf, records, simhash_dedup, warc
from remitlens.llm.common import new_folder, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they and the next document's are."""
    return fingerprint.edited_likeness(table(spark, sf_dir, "documents"))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every whole text; the field learns from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_crf.fit(docs.where(~quality_crf.held_out()), table(spark, sf_dir, "labels"))
    scored = quality_crf.score(docs, model)
    return scored.select("doc_id", quality_crf.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids and the end id, written as framed records in ascending doc_id order and read back."""
    folder = new_folder(spark, "token-records")
    docs = table(spark, sf_dir, "documents")
    records.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return records.read_checksums(spark, folder)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles and the groups that links of two bits make."""
    docs = table(spark, sf_dir, "documents")
    return simhash_dedup.groups(simhash_dedup.fingerprints(docs, shingle=3, lanes=1).drop("text_key"), radius=2).drop("component")


def op5_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every whole text by single-word counts and by the network."""
    return gru_lm.score_corpus(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of the bytes that they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector with all others."""
    return pivot_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back by splits of the archives."""
    folder = new_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder, min_bytes=0)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by sources' weights 1, 2, 3."""
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_mincut.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_quality_crf": op2_quality_crf,
    "op3_token_records": op3_token_records,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_gru_scores": op5_gru_scores,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_topk": op7_topk,
    "op8_warc": op8_warc,
    "op9_mixing": op9_mixing,
    "op10_html_text": op10_html_text,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op7_topk": pivot_topk.ORACLE, "op8_warc": warc.ORACLE}
