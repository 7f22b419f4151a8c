"""Gap sessions over event time with `session_window`, the same plan in batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def session_windows(chunks: DataFrame, gap_s: float, watermark: str | None = None) -> DataFrame:
    """(device_id, start_utc_ms, end_utc_ms, n_chunks): sessions by the latest end so far.

    The window of a row lasts its own length plus the gap, and windows that touch merge, so a pause
    equal to the gap stays inside, as in `sessions_by_gap(mode="max_end")`. On a stream give a
    `watermark` (for example "1 hour"); rows later than it are dropped from this preview and picked
    up by the batch rebuild.
    """
    rows = chunks.select("device_id", "end_utc_ms", F.timestamp_millis("start_utc_ms").alias("at"),
                         (F.col("end_utc_ms") - F.col("start_utc_ms")).alias("_len"))
    if watermark is not None:
        rows = rows.withWatermark("at", watermark)
    seconds = (F.col("_len") / 1000 + gap_s).cast("decimal(18,6)")
    gap = F.make_interval(secs=seconds)
    return (rows.groupBy("device_id", F.session_window("at", gap))
            .agg(F.unix_millis(F.min("at")).alias("start_utc_ms"), F.max("end_utc_ms").alias("end_utc_ms"),
                 F.count("*").alias("n_chunks"))
            .select("device_id", "start_utc_ms", "end_utc_ms", "n_chunks"))
