"""The corpus pipeline: quality, repeated lines, near-duplicate documents, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of docs. Stages read docs twice or more; rows are told apart by their file and place (common.numbered).
Extra columns are carried along; null texts stay null where a stage changes texts; empty tables give
empty results.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import line_dedup, near_documents, packing, quality, suffix_dedup
from attestor.llm.common import fold, numbered, prepare, table, unused

#: Scores below go.
KEEP_SCORE = 0.7


def _with_texts(rows: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """Numbered rows with new texts and their lengths, without their numbers; kept: (row, text)."""
    columns, was_null, text = [c for c in rows.columns if c != row], unused(rows, "__was_null"), unused(rows, "__text")
    new = kept.select(F.col(kept.columns[0]).alias(row), F.col(kept.columns[1]).alias(text))
    joined = rows.withColumn(was_null, F.col("text").isNull()).drop("text").join(new, row)
    joined = joined.withColumn("text", F.when(~F.col(was_null), F.col(text)))
    if "n_chars" in columns:
        kind = rows.schema["n_chars"].dataType
        joined = joined.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return joined.select(*[joined[c] for c in columns])


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (trained as in query op6).

    Null and empty texts are judged by the bias alone; without a labelled row all documents stay.
    Repeated rows have equal fates; an empty table gives an empty one.
    """
    weights = quality.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return docs.where(quality.scorer(spark, weights)(docs["text"]) >= KEEP_SCORE)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without lines that stand, equal or nearly so, in an earlier place."""
    row = unused(docs, "__row")
    rows = numbered(docs, row)
    return _with_texts(rows, row, line_dedup.drop_repeated_lines(rows, row_column=row).select("uid", "kept"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents (0.8 of their five-word shingles) the one with the smallest id (null ids last, then by row)."""
    row = unused(docs, "__row")
    rows = numbered(docs, row)
    groups = near_documents.near_documents(rows, id_column=row)
    ids = rows.select(row, F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col(row).alias("row")).alias("first"))
    first = groups.select(row, "component_id").join(ids, row).groupBy("component_id").agg(F.min("first").alias("first"))
    chosen = first.select(F.col("first.row").alias(row))
    return rows.join(chosen, row, "left_semi").select(*[rows[c] for c in docs.columns])


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without passages that also stand in an earlier place (whole characters only)."""
    row = unused(docs, "__row")
    rows = numbered(docs, row)
    done = suffix_dedup.find_repeats(rows, whole_characters=True, row_column=row)
    return _with_texts(rows, row, done.select("rid", F.col("kept").cast("string")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows, with their token ids.

    A null or empty text has its end alone; repeated rows are packed each on its own; an empty table
    gives an empty result.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_documents),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("suffix_dedup", without_repeated_passages),
    ("packing", packed),
]
#: SQL cannot express the classifier, the fingerprints and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared checkpoint folder and read again."""
    prepare(spark)
    docs, folder = table(spark, sf_dir, "documents"), f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
