"""The queries of this subpackage, each a thin layer over its operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import language, license_scan, line_dedup, suffix_dedup
from attestor.llm.ann import nearest
from attestor.llm.bpe_automaton import encode_documents
from attestor.llm.common import fold, table
from attestor.llm.packing import pack_documents
from attestor.llm.quality import score_documents, train
from attestor.llm.simhash import near_groups
from attestor.llm.sketch import compare_with_successors


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates of every document."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and decoded text."""
    done = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return compare_with_successors(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that every document loses to earlier equal or nearly equal lines."""
    done = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_byte_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows whose fold is 0 are held out of the training."""
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    net = language.train(docs.select("doc_id", "text", "lang"), ~held_out)
    done = language.predict_documents(docs.select("doc_id", "text"), net)
    return done.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: Scores from here on keep a document.
KEEP_SCORE = 0.7


def op6_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; rows whose fold is 2 are held out of the training."""
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 4) == 2
    weights = train(docs, table(spark, sf_dir, "labels"), ~held_out)
    done = score_documents(docs.select("doc_id", "text"), weights)
    score = F.col("quality_score")
    return done.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= KEEP_SCORE).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    done = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated passages take from every document."""
    done = suffix_dedup.find_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash and near-duplicate component of every document."""
    done = near_groups(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every row whose vec_id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_bpe_automaton, op3_threshold_sketch, op4_line_dedup, op5_byte_bigru, op6_quality_ftrl, op7_packing, op8_suffix_array, op9_simhash_vptree, op10_hilbert_ann)
}
ORACLES: dict[str, str] = {"op1_license_scan": license_scan.oracle(), "op4_line_dedup": line_dedup.ORACLE, "op8_suffix_array": suffix_dedup.ORACLE}
