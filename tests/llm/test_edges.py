"""Every query over awkward rows, an empty table, repeated rows and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestor.llm import queries as Q

from .conftest import AWKWARD, SCHEMA, rows_of

LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<float>, label int"
DOCUMENT_QUERIES = [n for n in Q.QUERIES if n != "op10_hilbert_ann"]


def _labels(n):
    return [(i, None if i % 5 == 4 else i % 2, None) for i in range(n)]


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_awkward_rows(spark, documents, name):
    folder = documents(rows_of(AWKWARD) + [(None, "no id at all", None, None, None)])
    documents(_labels(len(AWKWARD)), LABELS, "labels")
    got = Q.QUERIES[name](spark, folder).collect()
    ids = [r["doc_id"] for r in got]
    assert set(ids) == {*range(len(AWKWARD)), None}
    if name != "op7_packing":
        assert len(ids) == len(AWKWARD) + 1


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_empty_table(spark, documents, name):
    folder = documents([])
    documents([], LABELS, "labels")
    assert Q.QUERIES[name](spark, folder).count() == 0


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_repeated_rows_and_clashing_columns(spark, documents, name):
    texts = ["one two three four five six", "seven eight nine ten eleven", "one two three four five six"]
    extra = "kind string, at string, rid string, uid string, id string, doc string, h string, fp string, place string, score string, lang_pred string, kept string, line string, n string"
    plain = rows_of(texts) + rows_of(texts)
    more = [(*r, *["x"] * 14) for r in plain]
    documents(_labels(3), LABELS, "labels")
    a = Q.QUERIES[name](spark, documents(plain, files=1))
    columns = a.columns
    a = sorted(map(tuple, a.collect()))
    b = Q.QUERIES[name](spark, documents(more, f"{SCHEMA}, {extra}", files=1))
    assert b.columns == columns and (len(a) == 6 or name == "op7_packing") and sorted(map(tuple, b.collect())) == a


def test_vectors(spark, documents):
    good = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [1.0, 0.0], [-1.0, 0.0]]
    bad = [None, [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0]]
    rows = [(i, v, 0) for i, v in enumerate(good + bad)] + [(50, [1.0, 0.0], 0), (50, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)]
    rows += [(100, [1.0, 0.0, 0.0], 0), (101, [0.0, 2.0, 0.0], 0), (150, [7.0], 0)]  # each length is a space of its own
    got = Q.op10_hilbert_ann(spark, documents(rows, VECTORS, "embeddings")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got][10:] == [(100, 1, 101, 0.0)]
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got][:10] == [(0, 1, 3), (0, 2, 50), (0, 3, 2), (0, 4, 1), (0, 5, 4), (50, 1, 0), (50, 2, 3), (50, 3, 2), (50, 4, 1), (50, 5, 4)]
    assert got[0]["score"] == 1.0 and abs(got[2]["score"] - 0.5**0.5) < 1e-15
    assert Q.op10_hilbert_ann(spark, documents([], VECTORS, "embeddings")).count() == 0
    assert Q.op10_hilbert_ann(spark, documents([(1, [1.0, 2.0], 0)], VECTORS, "embeddings")).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_over_awkward_rows(spark, documents, stage):
    folder = documents([(*r, "x", 1) for r in rows_of(AWKWARD) + rows_of(AWKWARD)], f"{SCHEMA}, uid string, rid int")
    documents([], LABELS, "labels")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.STAGES[stage][1](spark, docs, folder)
    if stage < 4:
        assert got.schema == docs.schema
        assert got.where(F.col("n_chars") != F.length("text")).count() == 0
    assert got.count() > 0
    empty = docs.limit(0)
    empty.write.mode("overwrite").parquet(f"{folder}/none")
    assert corpus_pipeline.STAGES[stage][1](spark, spark.read.parquet(f"{folder}/none"), folder).count() == 0
