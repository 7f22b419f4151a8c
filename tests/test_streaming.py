"""Streams give what the batch jobs give."""

import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import search
from tidemark.operators.chunking import speech_chunks
from tidemark.sources import sidecars as SC
from tidemark.streaming.ingest import start_ingest
from tidemark.streaming.segments import OUT, chunk_stream
from tidemark.streaming.sessions import session_windows

from test_chunking import random_probs, segments_of


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_stream_equals_batch(spark, tmp):
    rows, flat = [], []
    for k in range(3):
        probs = random_probs(random.Random(40 + k), 2600)
        flat += [(f"d{k}", i, p) for i, p in enumerate(probs)]
        rows += [(f"d{k}", "r", 0, s.first_idx, s.probs, s.ends, s.n_end) for s in segments_of(probs, 500)]
    ddl = "device_id string, run_id string, epoch bigint, first_idx bigint, probs array<double>, ends string, n_end bigint"
    df = spark.createDataFrame(rows, ddl)
    for lo in (0, 1000, 2000):  # three files, three micro-batches
        df.where((F.col("first_idx") >= lo) & (F.col("first_idx") < lo + 1000)).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")
    q = (chunk_stream(stream).writeStream.format("parquet").option("path", f"{tmp}/out")
         .option("checkpointLocation", f"{tmp}/cp").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {(r.device_id, r.n_start, r.n_end, r.cut_reason) for r in spark.read.schema(OUT).parquet(f"{tmp}/out").where("kind = 'chunk'").collect()}
    batch = speech_chunks(spark.createDataFrame(flat, "stream string, idx bigint, prob double"), ["stream"])
    assert got == {tuple(r) for r in batch.collect()}


def sidecar(i, **over):
    body = {"schema_version": 1, "device_id": f"dev-{i % 3}", "sha256": f"{i:064x}", "start_utc": f"2026-09-2{i % 5}T10:00:00.{i:03d}Z",
            "duration_s": 2.5, "run_id": "00000000-0000-4000-8000-000000000000", "epoch": 0, "discontinuity": False,
            "clock_synced": True, "extra": {"kept": i}}
    body.update(over)
    return json.dumps({k: v for k, v in body.items() if v is not None})


def test_ingest_stream_is_idempotent(spark, tmp):
    rows = [(sidecar(i), i) for i in range(20)] + [(sidecar(3), 50), (sidecar(21, epoch=-1), 21), ("not json", 22),
            (sidecar(30, kind="raw", n_start=0, n_samples=40_000, cut_reason="shutdown"), 30)]
    spark.createDataFrame(rows, "raw string, received_utc_ms bigint").coalesce(1).write.parquet(f"{tmp}/in")

    def run(cp):
        s = spark.readStream.schema("raw string, received_utc_ms bigint").parquet(f"{tmp}/in")
        start_ingest(s, f"{tmp}/db", f"{tmp}/{cp}", available_now=True).awaitTermination(120)

    run("cp1")
    run("cp2")  # a second run over the same files must add nothing
    chunks = spark.read.parquet(f"{tmp}/db/chunks")
    assert chunks.count() == 20 and spark.read.parquet(f"{tmp}/db/raw_segments").count() == 1
    row = chunks.where(F.col("sha256") == f"{3:064x}").first()
    assert row.received_utc_ms == 3 and json.loads(row.meta_json)["extra"] == {"kept": 3}
    assert row.path == f"2026/09/23/20260923T100000003Z_{'0' * 8}.opus"
    errors = {r.error for r in spark.read.parquet(f"{tmp}/db/quarantine").collect()}
    assert errors == {"epoch: no count", "not a JSON object"}


def test_ingest_batches_of_one_kind_restated_dates_and_ties(spark, tmp):
    from tidemark.streaming.ingest import ingest_batch
    raw = {"kind": "raw", "n_start": 0, "n_samples": 40_000, "cut_reason": "shutdown"}
    frame = lambda rows: spark.createDataFrame(rows, "raw string, received_utc_ms bigint")
    batches = [
        [(sidecar(1), 1)],  # speech alone, then raw alone
        [(sidecar(2, **raw), 2), ("not json", 3)],
        [(sidecar(1, start_utc="2026-09-24T09:00:00.000Z"), 9), (sidecar(1, **raw), 9), ("not json", 12)],  # restated; the same hash as the other kind
        [(sidecar(5, duration_s=2.0), 7), (sidecar(5, duration_s=1.0), 7)],
    ]
    for rows in [*batches, *batches]:
        ingest_batch(frame(rows), f"{tmp}/db")
    chunks = {r.sha256: r for r in spark.read.parquet(f"{tmp}/db/chunks").collect()}
    assert spark.read.parquet(f"{tmp}/db/chunks").count() == 2 and chunks[f"{1:064x}"].received_utc_ms == 1
    assert chunks[f"{5:064x}"].duration_ms == 1000
    assert spark.read.parquet(f"{tmp}/db/raw_segments").count() == 2
    assert spark.read.parquet(f"{tmp}/db/quarantine").count() == 1


def test_session_stream_equals_batch(spark, tmp):
    from tidemark.plans import views
    chunks = views.chunks(spark, "/root/testdata/sf0.001").select("device_id", "start_utc_ms", "end_utc_ms")
    chunks.coalesce(1).write.parquet(f"{tmp}/in")
    stream = spark.readStream.schema(chunks.schema).parquet(f"{tmp}/in")
    q = (session_windows(stream, 14_400.0, "1 hour").writeStream.format("memory").queryName("preview")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(120)
    done = {tuple(r) for r in spark.table("preview").collect()}
    batch = {tuple(r) for r in session_windows(chunks, 14_400.0).collect()}
    assert done and done <= batch


def test_index_gives_the_scores_of_a_scan(spark, tmp):
    from tidemark.plans import views
    corpus = views.search_corpus(spark, "/root/testdata/sf0.001")
    search.write_index(corpus.where("id % 2 = 0"), f"{tmp}/ix", part=0, buckets=4)
    search.append_index(corpus.where("id % 2 = 1"), f"{tmp}/ix", 1, buckets=4)
    search.append_index(corpus.where("id % 2 = 1"), f"{tmp}/ix", 1, buckets=4)  # replay
    got = {r.id: round(r.score, 9) for r in search.search_index(spark, f"{tmp}/ix", "the only", 4).collect()}
    want = {r.id: round(r.score, 9) for r in search.literal_matches(corpus, "the only").collect()}
    assert got == want and got


def test_files_round_trip(spark, tmp):
    import hashlib
    import os
    audio = b"not really opus"
    sha = hashlib.sha256(audio).hexdigest()
    folder = f"{tmp}/archive/2026/09/23"
    os.makedirs(folder)
    name = f"{folder}/20260923T100000003Z_{sha[:8]}"
    open(name + ".opus", "wb").write(audio)
    open(name + ".json", "w").write(sidecar(3, sha256=sha))
    side = SC.read_sidecars(spark, f"{tmp}/archive")
    files = SC.hash_audio(spark, f"{tmp}/archive").withColumn("path", F.regexp_extract("path", r"(\d{4}/\d{2}/\d{2}/[^/]+)$", 1))
    rel = F.regexp_replace(F.regexp_extract("file_path", r"(\d{4}/\d{2}/\d{2}/[^/]+)$", 1), "json$", "opus")
    both = side.select(rel.alias("path"), "raw").join(files.select("path", "file_sha256", F.col("modified_ms").alias("received_utc_ms")), "path")
    none = spark.createDataFrame([], "path string, sha256 string")
    assert [r.sha256 for r in SC.orphan_rows(both, none).collect()] == [sha]
