"""Sidecars and span bodies: scan, validate, de-duplicate, build rows, write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.checks import MAX_CANCELLED_MS, SIDECAR_PATHS, SPAN_PATHS, Body, facts_of, first_failure, sidecar_rules, span_error
from ..functions.text import strip
from ..functions.times import archive_path, iso_to_ms

RAW_PREFIX = "raw/"


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, raw): one row per JSON sidecar below `path`, text byte for byte."""
    return (spark.read.option("wholetext", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.json").text(path)
            .select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("raw")))


def stream_sidecars(spark: SparkSession, path: str, max_files: int = 10_000) -> DataFrame:
    return (spark.readStream.option("wholetext", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", max_files).text(path)
            .select(F.col("_metadata.file_path").alias("file_path"),
                    F.unix_millis("_metadata.file_modification_time").alias("received_utc_ms"),
                    F.col("value").alias("raw")))


def hash_audio(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_sha256, length, modified_ms) of audio files; the bytes stay in the task."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.opus").load(path))
    return files.select("path", F.sha2("content", 256).alias("file_sha256"), "length",
                        F.unix_millis("modificationTime").alias("modified_ms"))


CORE = ("kind", "device_id", "sha256", "start_utc_ms", "duration_s", "run_id", "epoch", "n_start", "n_samples",
        "discontinuity", "clock_synced", "cut_reason", "edge_version")

#: Rules that are compiled as one method: the JVM leaves methods above 8,000 bytes of code to its interpreter.
RULES = 12


def checked(sidecars: DataFrame) -> DataFrame:
    """Add `error` (NULL for valid rows) and the core fields; `raw` stays, unknown fields included.

    One parse serves both, and valid and quarantined rows are two filters over the same result.
    """
    b = Body(SIDECAR_PATHS)
    start = F.col("_start")
    fields = [F.coalesce(b.text("kind"), F.lit("speech")), b.text("device_id"), b.text("sha256"), start,
              b.number("duration_s"), b.text("run_id"), b.long("epoch"), b.long("n_start"), b.long("n_samples"),
              b.flag("discontinuity"), b.flag("clock_synced"), b.text("cut_reason"), b.text("edge_version")]
    rows, rules = b.attach(sidecars).withColumn("_start", iso_to_ms(b.text("start_utc"))), sidecar_rules(b, start)
    parts = [rules[i:i + RULES] for i in range(0, len(rules), RULES)]
    for i, part in enumerate(parts):
        rows = _settled(rows, rows.columns, [first_failure(part).alias(f"_e{i}")])
    error = F.coalesce(*[f"_e{i}" for i in range(len(parts))])
    return _settled(rows, sidecars.columns, [error.alias("error"), *[f.alias(n) for f, n in zip(fields, CORE)]])


def _settled(df: DataFrame, keep: list[str], computed: list[Column]) -> DataFrame:
    """Computed columns behind a one-row generator.

    A filter on `error` then stays a filter on a plain column: pushed below, the whole rule chain
    would be copied into the predicate and the constraints inferred from it.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*computed))))


def valid(rows: DataFrame) -> DataFrame:
    return rows.where("error is null").drop("error")


def quarantined(rows: DataFrame) -> DataFrame:
    return rows.where("error is not null").drop(*CORE)


def first_per(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The earliest row per key, the lesser body among equals: an aggregate, so copies collapse before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    body = [c for c in ("raw", "meta_json", "body_json") if c in rest]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(order, *body)).alias("_r")).select(*key, "_r.*")


def new_rows(rows: DataFrame, stored: DataFrame, key: list[str], order: str = "received_utc_ms") -> DataFrame:
    """Idempotent ingest: first arrival per key, without keys already stored."""
    return first_per(rows, key, order).join(stored.select(*key), key, "left_anti")


def is_raw() -> Column:
    return F.col("kind") == "raw"


def path_of(prefix_raw: bool = True) -> Column:
    return archive_path("start_utc_ms", "sha256", F.when(is_raw(), RAW_PREFIX).otherwise("") if prefix_raw else "")


def chunk_rows(rows: DataFrame) -> DataFrame:
    """Chunk rows of parsed speech sidecars; the length rounds half to even."""
    duration = F.bround(F.col("duration_s") * 1000).cast("bigint")
    return rows.where(~is_raw()).select(
        "sha256", "device_id", "start_utc_ms", (F.col("start_utc_ms") + duration).alias("end_utc_ms"),
        duration.alias("duration_ms"), path_of().alias("path"), F.col("raw").alias("meta_json"), "run_id", "epoch",
        "discontinuity", "clock_synced", "received_utc_ms", F.lit("pending").alias("status"))


def raw_rows(rows: DataFrame) -> DataFrame:
    return rows.where(is_raw()).select(
        "sha256", "device_id", "run_id", "epoch", "n_start", "n_samples", "start_utc_ms", "discontinuity",
        "clock_synced", "cut_reason", path_of().alias("path"), F.col("raw").alias("meta_json"), "received_utc_ms",
        F.lit("pending").alias("status"))


def write_partitioned(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by UTC date of the start, sorted by device and time inside files.

    Rows are spread by (date, device slice) first: one file per task and date, and a busy date is
    many tasks.
    """
    day = F.to_date(F.timestamp_millis("start_utc_ms"))
    (rows.withColumn("date", day).repartition("date", F.pmod(F.xxhash64("device_id", "start_utc_ms"), F.lit(32)))
     .sortWithinPartitions("date", "device_id", "start_utc_ms")
     .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path))


def orphan_rows(files: DataFrame, known: DataFrame) -> DataFrame:
    """Archive files without a row whose sidecar, name and hash agree.

    `files`: path (relative), raw, file_sha256, received_utc_ms. `known`: path, sha256 of both tables.
    """
    unknown = files.join(known.select("path").distinct(), "path", "left_anti")
    usable = valid(checked(unknown))
    agree = (F.col("sha256") == F.col("file_sha256")) & (F.col("path") == path_of())
    fresh = usable.where(agree).drop("file_sha256")
    return fresh.join(known.select("sha256").distinct(), "sha256", "left_anti")


# ------------------------------------------------------------- dictation spans


def checked_spans(bodies: DataFrame) -> DataFrame:
    """Bodies (`raw`, ...) with `error` and normalised span fields: language code lower-cased, an empty
    text is a cancelled one, a cancelled one is clamped to ten minutes."""
    b = Body(SPAN_PATHS)
    timed = (b.attach(bodies).withColumn("_start", iso_to_ms(b.text("start_utc")))
             .withColumn("_end", iso_to_ms(b.text("end_utc"))).withColumn("facts", facts_of(b)))
    start, end = F.col("_start"), F.col("_end")
    text = F.coalesce(b.text("text"), F.lit(""))
    gone = F.coalesce(b.flag("cancelled"), F.lit(False)) | (F.length(strip(text)) == 0)
    clamped = F.when(gone, F.least(end, start + MAX_CANCELLED_MS)).otherwise(end)
    return _settled(timed.withColumn("body_json", F.col("raw")), [*[c for c in bodies.columns if c != "raw"], "body_json"], [
        span_error(b, start, end).alias("error"), b.text("device_id").alias("device_id"), start.alias("start_utc_ms"),
        clamped.alias("end_utc_ms"), text.alias("text"), F.lower(F.btrim(b.text("lang"))).alias("lang"),
        b.text("engine").alias("engine"), b.text("mode").alias("mode"), F.col("facts")["app"].alias("app"),
        F.col("facts")["window"].alias("window"), gone.alias("cancelled"), b.text("origin").alias("origin"),
        F.col("facts").alias("facts")])
