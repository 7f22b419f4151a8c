"""Sidecar ingest as a stream: validate, quarantine, drop what is stored, append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import append_index
from ..sources import sidecars as SC


def stored_hashes(spark: SparkSession, path: str, part: str, kind: str, values: list) -> DataFrame:
    """(sha256) of the rows stored under `path`; only the given values of the partition column are read."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = f"sha256 string, {part} {kind}"
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], "sha256 string")
    return spark.read.schema(schema).parquet(path).where(F.col(part).isin(values)).select("sha256")


def prefix() -> Column:
    """256 partitions of hashes."""
    return F.substring("sha256", 1, 2)


def ingest_batch(batch: DataFrame, root: str) -> None:
    """One micro-batch of (raw, received_utc_ms) into `<root>/chunks`, `raw_segments`, `quarantine`.

    The first sidecar of a hash wins in each table; ties on arrival go to the lesser body. Stored hashes are found
    by their prefix in `<root>/keys`, whatever date a repeat states. Keys are written after the rows; if a batch
    breaks off between the two, its replay finds the rows by their dates, which are the same. A bad body is
    kept once, by its hash.
    """
    spark = batch.sparkSession
    rows = SC.checked(batch).persist()
    try:
        bad = SC.quarantined(rows).withColumn("sha256", F.sha2(F.coalesce("raw", F.lit("")), 256))
        bad = SC.first_per(bad, ["sha256"], "received_utc_ms").withColumn("prefix", prefix())
        at = f"{root}/quarantine"
        known = stored_hashes(spark, at, "prefix", "string", values(bad, "prefix"))
        append(bad.join(known, "sha256", "left_anti"), at)
        for name, make in (("chunks", SC.chunk_rows), ("raw_segments", SC.raw_rows)):
            made = SC.first_per(make(SC.valid(rows)), ["sha256"], "received_utc_ms").withColumn("prefix", prefix())
            made = made.withColumn("date", F.to_date(F.timestamp_millis("start_utc_ms"))).persist()
            known = stored_hashes(spark, f"{root}/keys/{name}", "prefix", "string", values(made, "prefix"))
            broken = stored_hashes(spark, f"{root}/{name}", "date", "date", values(made, "date"))
            fresh = made.join(known.union(broken), "sha256", "left_anti").drop("prefix", "date")
            if fresh.limit(1).count():
                SC.write_partitioned(fresh, f"{root}/{name}")
            keys = made.select("sha256", "prefix").join(known, "sha256", "left_anti")
            append(keys, f"{root}/keys/{name}")
            made.unpersist()
    finally:
        rows.unpersist()


def values(df: DataFrame, column: str) -> list:
    """The distinct values of a partition column: 256 prefixes or the days of a batch at most."""
    return [r[0] for r in df.select(column).distinct().collect()]


def append(rows: DataFrame, path: str) -> None:
    if rows.limit(1).count():
        rows.write.mode("append").partitionBy("prefix").parquet(path)


def start_ingest(sidecars: DataFrame, root: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Run `ingest_batch` on a stream from `sources.sidecars.stream_sidecars`."""
    writer = sidecars.select("raw", "received_utc_ms").writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.foreachBatch(lambda df, _: ingest_batch(df, root)).start()


def start_index(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keep a written token index in step with a stream of new rows (id, text)."""
    writer = rows.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.foreachBatch(lambda df, n: append_index(df, path, n)).start()
