"""Calendar buckets in local time and the per-bucket evidence rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.times import local_date, samples_to_ms_floor
from .intervals import overlaps_window, to_buckets

GRID_MS = 900_000  # zone offsets are multiples of a quarter of an hour


def calendar_edges(spark: SparkSession, from_ms: int, to_ms: int, tz: str, bucket: str = "hour") -> DataFrame:
    """`edge_ms`: the window's ends and every local hour or day start strictly inside it.

    A quarter-hour UTC grid is rendered in the zone. Hours start where the local clock shows a whole
    hour, which gives both passes of a repeated hour and none of a skipped one. Days start at local
    midnight, or at the first instant of a date whose midnight is skipped.
    """
    if bucket not in ("hour", "day"):
        raise ValueError("bucket must be hour or day")
    first = -(-from_ms // GRID_MS)
    last = to_ms // GRID_MS
    grid = spark.range(first, last + 1).select((F.col("id") * GRID_MS).alias("edge_ms"))
    local = F.from_utc_timestamp(F.timestamp_millis("edge_ms"), tz)
    before = F.from_utc_timestamp(F.timestamp_millis(F.col("edge_ms") - GRID_MS), tz)
    whole = (F.minute(local) == 0) & (F.second(local) == 0)
    if bucket == "day":
        whole = (whole & (F.hour(local) == 0)) | (F.to_date(local) > F.to_date(before))
    ends = spark.range(1).select(F.explode(F.array(F.lit(from_ms), F.lit(to_ms)).cast("array<bigint>")).alias("edge_ms"))
    inside = grid.where(whole & (F.col("edge_ms") > from_ms) & (F.col("edge_ms") < to_ms))
    return inside.unionByName(ends)


def buckets_of(edges: DataFrame) -> DataFrame:
    """Consecutive edges as `bucket_from`, `bucket_to`. The grid is bounded by the requested range."""
    ordered = edges.agg(F.sort_array(F.collect_set("edge_ms")).alias("e"))
    pairs = F.zip_with(F.slice("e", 1, F.size("e") - 1), F.slice("e", 2, F.size("e") - 1),
                       lambda a, b: F.struct(a.alias("bucket_from"), b.alias("bucket_to")))
    return ordered.select(F.inline(pairs))


def source_extents(chunks: DataFrame, raw: DataFrame, spans: DataFrame) -> DataFrame:
    """First and last known instant per device over chunks, raw segments and spans."""
    both = (chunks.select("device_id", "start_utc_ms", "end_utc_ms")
            .unionByName(raw.select("device_id", "start_utc_ms", raw_end().alias("end_utc_ms")))
            .unionByName(spans.select("device_id", "start_utc_ms", "end_utc_ms")))
    return both.groupBy("device_id").agg(F.min("start_utc_ms").alias("first_known_ms"),
                                         F.max("end_utc_ms").alias("last_known_ms"))


def raw_end() -> Column:
    return F.col("start_utc_ms") + samples_to_ms_floor("n_samples")


KINDS = ("text", "captured", "pending", "failed", "segmented", "derived")


def timeline(spark: SparkSession, rows: DataFrame, chunks: DataFrame, raw: DataFrame, spans: DataFrame,
             from_ms: int, to_ms: int, tz: str, bucket: str = "hour", device_id: str | None = None) -> DataFrame:
    """Per device and local calendar bucket: covered text time, row count and capture evidence.

    `rows` are the transcript rows that pass the read policy. Every interval is clipped to buckets
    first, so the union is taken inside `(device, bucket)`; edges are summed per instant before the
    shuffle, which bounds a bucket by its milliseconds whatever the number of rows.
    """
    def source(df: DataFrame, end: Column, **flags: Column) -> DataFrame:
        zero = F.lit(0)
        return df.select("device_id", "start_utc_ms", end.alias("end_utc_ms"),
                         *[flags.get(k, zero).cast("int").alias(k) for k in KINDS])

    one, status, end = F.lit(1), F.col("status"), F.col("end_utc_ms")
    parts = (source(rows, end, text=one)
             .unionByName(source(chunks, end, captured=one, pending=status == "pending", failed=status == "failed",
                                 derived=F.col("kind") == "derived"))
             .unionByName(source(raw, raw_end(), captured=one, pending=status == "pending",
                                 failed=status == "failed", segmented=status == "segmented")))
    parts = parts.where(overlaps_window(from_ms, to_ms))
    sources = source_extents(chunks, raw, spans).select("device_id")
    if device_id is not None:
        parts, sources = parts.where(F.col("device_id") == device_id), sources.where(F.col("device_id") == device_id)

    grid = buckets_of(calendar_edges(spark, from_ms, to_ms, tz, bucket))
    pieces = to_buckets(parts, F.broadcast(grid), "start_utc_ms", "end_utc_ms")
    key = ["device_id", "bucket_from", "bucket_to"]
    marks = F.explode(F.array(F.struct(F.col("_a").alias("at"), F.lit(1).alias("sign")),
                              F.struct(F.col("_b").alias("at"), F.lit(-1).alias("sign"))))
    opens = ((F.col("_m.sign") == 1) & F.col("_opens") & (F.col("text") == 1)).cast("int")
    deltas = (pieces.withColumn("_m", marks).groupBy(*key, F.col("_m.at").alias("_at"))
              .agg(*[F.sum(F.col("_m.sign") * F.col(k)).alias(k) for k in KINDS], F.sum(opens).alias("_n")))
    w = Window.partitionBy(*key).orderBy("_at")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = deltas.select(*key, "_n", (F.lead("_at").over(w) - F.col("_at")).alias("_len"),
                          *[(F.sum(k).over(run) > 0).alias(k) for k in KINDS])

    def total(cond: Column, name: str) -> Column:
        return F.sum(F.when(cond, F.col("_len")).otherwise(0)).alias(name)

    per = depth.groupBy(*key).agg(
        total(F.col("text"), "text_ms"), F.sum("_n").alias("n_segments"), total(F.col("captured"), "captured_ms"),
        total(F.col("pending"), "pending_ms"), total(F.col("failed"), "failed_ms"),
        total(F.col("segmented") & ~F.col("derived"), "no_detected_speech_ms"))
    # The full device x bucket grid is the result's own size; devices are exploded over it.
    all_buckets = grid.agg(F.collect_list(F.struct("bucket_from", "bucket_to")).alias("b")).scalar()
    full = sources.select("device_id", F.inline(all_buckets))
    values = ["text_ms", "n_segments", "captured_ms", "pending_ms", "failed_ms", "no_detected_speech_ms"]
    out = full.join(per, key, "left").select(
        "device_id", F.col("bucket_from").alias("from_ms"), F.col("bucket_to").alias("to_ms"),
        *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])
    return out.withColumn("unknown_ms", F.col("to_ms") - F.col("from_ms") - F.col("captured_ms"))


def daily_evidence(buckets: DataFrame, tz: str) -> DataFrame:
    """Sum of bucket evidence per device and local date."""
    cols = ["n_segments", "captured_ms", "pending_ms", "failed_ms", "no_detected_speech_ms", "unknown_ms"]
    return buckets.groupBy("device_id", local_date("from_ms", tz).alias("local_date")).agg(
        *[F.sum(c).alias(c) for c in cols])
