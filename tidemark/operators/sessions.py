"""Gap sessions per device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.times import session_id
from .sliced import SLICE, Carry, scan, with_slice


def _instants(chunks: DataFrame) -> DataFrame:
    """One row per (device, start).

    Rows that share a start never open a session against each other, so they collapse into one
    before the shuffle: `last_end` is the end the next row is compared with (largest id).
    """
    return (chunks.groupBy("device_id", "start_utc_ms")
            .agg(F.max_by("end_utc_ms", "id").alias("last_end"), F.max("end_utc_ms").alias("max_end"),
                 F.count("*").alias("n")))


def session_starts(chunks: DataFrame, gap_ms: int, mode: str = "lag") -> DataFrame:
    """(device_id, start_utc_ms) with the start of the session they fall into.

    `mode="lag"` compares a start with the end of the previous row; `mode="max_end"` with the
    latest end so far, which is what a session window computes.
    """
    instants = with_slice(_instants(chunks), "start_utc_ms")
    start = F.col("start_utc_ms")

    def opens(prev: Column) -> Column:
        return F.when(prev.isNull() | (start - prev > gap_ms), start)

    if mode == "max_end":
        carry = Carry("_prev", "max_before", F.col("max_end"))
        flagged = scan(instants, ["device_id"], ["start_utc_ms"], [carry]).withColumn("_open", opens(F.col("_prev")))
        return scan(flagged, ["device_id"], ["start_utc_ms"], [Carry("session_start_ms", "last", F.col("_open"))])
    if mode != "lag":
        raise ValueError(f"unknown mode {mode}")
    # Only the first row of a slice needs anything from earlier slices, so one summary settles both
    # the previous end and the running session start.
    local = Window.partitionBy("device_id", SLICE).orderBy("start_utc_ms")
    prev = F.lag("last_end").over(local)
    flagged = (instants.withColumn("_prev", prev)
               .withColumn("_open", F.when(F.col("_prev").isNotNull(), opens(F.col("_prev")))))
    summary = flagged.groupBy("device_id", SLICE).agg(
        F.min("start_utc_ms").alias("_first"), F.max_by("last_end", "start_utc_ms").alias("_reach"),
        F.max("_open").alias("_last_open"))
    along = Window.partitionBy("device_id").orderBy(SLICE)
    reach_in = F.lag("_reach").over(along)
    edges = summary.withColumn("_first_open", F.when(
        reach_in.isNull() | (F.col("_first") - reach_in > gap_ms), F.col("_first")))
    open_after = F.coalesce("_last_open", "_first_open")
    entry = edges.select("device_id", SLICE, F.coalesce(
        F.col("_first_open"),
        F.last(open_after, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))).alias("_entry"))
    here = F.last("_open", ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (flagged.withColumn("_here", here).join(entry, ["device_id", SLICE], "left")
            .select("device_id", "start_utc_ms", "max_end", "n",
                    F.coalesce("_here", "_entry").alias("session_start_ms")))


def sessions_by_gap(chunks: DataFrame, gap_s: float, as_of_ms: int | Column | None = None,
                    segments: DataFrame | None = None, previous: DataFrame | None = None,
                    mode: str = "lag") -> DataFrame:
    """Sessions with id, extent, counts and `closed` (`as_of - end > gap`).

    `segments` (chunk_id, superseded_by) adds the count of rows still visible; `previous`
    (session_id, title, summary, multi_speaker) keeps those fields for ids that survive.
    """
    gap_ms = int(round(gap_s * 1000))
    starts = session_starts(chunks, gap_ms, mode)
    out = (starts.groupBy("device_id", "session_start_ms")
           .agg(F.max("max_end").alias("end_utc_ms"), F.sum("n").alias("n_chunks"))
           .select(session_id("device_id", "session_start_ms").alias("session_id"), "device_id",
                   F.col("session_start_ms").alias("start_utc_ms"), "end_utc_ms", "n_chunks",
                   F.lit(float(gap_s)).alias("gap_s")))
    if as_of_ms is not None:
        now = as_of_ms if isinstance(as_of_ms, Column) else F.lit(as_of_ms).cast("bigint")
        out = out.withColumn("closed", now - F.col("end_utc_ms") > gap_ms)
    if segments is not None:
        live = segments.where("superseded_by is null and chunk_id is not null").groupBy("chunk_id").agg(
            F.count("*").alias("_live"))
        counts = (assign_sessions(chunks, gap_s, mode).join(live, F.col("id") == F.col("chunk_id"))
                  .groupBy("session_id").agg(F.sum("_live").alias("n_segments")))
        out = out.join(counts, "session_id", "left").withColumn("n_segments", F.coalesce("n_segments", F.lit(0)))
    if previous is not None:
        out = out.join(previous.select("session_id", "title", "summary", "multi_speaker"), "session_id", "left")
    return out


def assign_sessions(chunks: DataFrame, gap_s: float, mode: str = "lag") -> DataFrame:
    """(id, session_id) for every chunk, by an equi-join on (device, start)."""
    starts = session_starts(chunks, int(round(gap_s * 1000)), mode).select(
        "device_id", "start_utc_ms", session_id("device_id", "session_start_ms").alias("session_id"))
    return chunks.select("id", "device_id", "start_utc_ms").join(starts, ["device_id", "start_utc_ms"]).select(
        "id", "session_id")


def session_openings(sessions: DataFrame, rows: DataFrame, include_empty: bool) -> DataFrame:
    """Sessions with the number of visible rows and the first text by (start, device, id).

    `rows` are visible transcript rows with `session_id`. Sessions without one are kept only when
    `include_empty`.
    """
    per = rows.groupBy("session_id").agg(
        F.count("*").alias("n_visible_segments"),
        F.min_by("text", F.struct("start_utc_ms", "device_id", "id")).alias("opening"))
    joined = sessions.join(per, "session_id", "left" if include_empty else "inner")
    return joined.withColumn("n_visible_segments", F.coalesce("n_visible_segments", F.lit(0)))
