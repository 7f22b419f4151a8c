"""Queries that once left out a part of their input."""

from pyspark.sql import functions as F

from tidemark.plans import views as V
from tidemark.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_archive_problems_compares_raw_rows(spark):
    got = {(r["problem"]) for r in QUERIES["archive_problems"].run(spark, SF).where("path like 'raw/%'").collect()}
    assert got == {"row without file", "sidecar without audio", "audio without sidecar", "sha256 mismatch", "kind does not belong here", "row points elsewhere"}


def test_transcribe_takes_short_documents(spark, tmp_path):
    texts = [(0, "x" * 10), (1, "y" * 6), (2, "z" * 4), (4, "a word " * 90), (5, "short"), (6, ""), (7, None), (8, "q")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["transcribe"].run(spark, str(tmp_path)).collect()
    assert {r["window_id"] for r in got} == {0, 1, 2} and all(r["n_chars"] and r["error"] is None for r in got)
    docs = V.table(spark, SF, "documents").where(F.octet_length("text") >= 2)
    assert {r["window_id"] for r in QUERIES["transcribe"].run(spark, SF).collect()} == {r[0] for r in docs.selectExpr("doc_id div 2").distinct().collect()}
