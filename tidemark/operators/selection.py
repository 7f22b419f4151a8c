"""Units, selections and playback order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import ends_sentence
from ..functions.times import floor_div
from .intervals import as_of
from .visibility import join_chunks

HOUR_MS = 3_600_000


def sentence_numbers(units: DataFrame) -> DataFrame:
    """Add `sentence`, the count of sentence-ending units before a unit in its row.

    `units` has segment_id, i, text. The window is one transcript row.
    """
    w = Window.partitionBy("segment_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return units.withColumn("sentence", F.coalesce(F.sum(ends_sentence("text").cast("bigint")).over(w), F.lit(0)))


PRECISIONS = ("word", "sentence", "segment", "hour", "session")


def bounds(units: DataFrame, precision: str) -> DataFrame:
    """(device_id, group_key, from_ms, to_ms, n_units): what a selection snaps to, one of PRECISIONS.

    `units` has device_id, start_utc_ms, end_utc_ms and segment_id (or id); for words i, for sentences `sentence` of
    `sentence_numbers`, for sessions session_id. A unit without a session goes with its segment.
    """
    segment = (F.col("segment_id") if "segment_id" in units.columns else F.col("id")).cast("string")

    def within(c: str) -> Column:
        return F.concat_ws("/", segment, F.col(c).cast("string"))

    group = {"word": lambda: within("i"), "sentence": lambda: within("sentence"), "segment": lambda: segment,
             "hour": lambda: floor_div("start_utc_ms", HOUR_MS).cast("string"), "session": lambda: F.coalesce("session_id", segment)}[precision]()
    return units.groupBy("device_id", group.alias("group_key")).agg(
        F.min("start_utc_ms").alias("from_ms"), F.max("end_utc_ms").alias("to_ms"), F.count("*").alias("n_units"))


def unit_clips(selected: DataFrame, rows: DataFrame) -> DataFrame:
    """One clip per selection of units (selection_id, device_id, segment_id, i, text, start_utc_ms, end_utc_ms).

    `rows` has segment_id, text, n_units and start_utc_ms. A row that is selected whole is quoted as it is, a part of
    one by its units in order, without blanks at both ends.
    """
    part = selected.groupBy("selection_id", "segment_id").agg(
        F.min("device_id").alias("device_id"), F.max("device_id").alias("_other"), F.min("start_utc_ms").alias("_from"), F.max("end_utc_ms").alias("end_utc_ms"),
        F.count("*").alias("_n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda u: u["text"]), "").alias("_part"))
    quoted = part.join(rows.select("segment_id", "n_units", F.col("text").alias("_whole"), "start_utc_ms"), "segment_id").withColumn(
        "text", F.when(F.col("_n") == F.col("n_units"), F.col("_whole")).otherwise(F.trim("_part")))
    ends = quoted.groupBy("selection_id").agg(F.min("_from").alias("_first"), F.max("_other").alias("_other"))
    out = clips(quoted.withColumn("device_id", F.when(F.col("device_id") == F.col("_other"), F.col("device_id")).otherwise(
        F.raise_error(F.lit("a selection must stay on one device"))))).join(ends, "selection_id")
    return out.select("selection_id", "device_id", F.col("_first").alias("from_ms"), "to_ms", "quoted_text")


def clips(selected: DataFrame) -> DataFrame:
    """One clip per selection of rows: extent and the quoted text in time order.

    A selection stays on one device: one that does not is an error.
    """
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_utc_ms", "segment_id", "text"))),
                                    lambda r: r["text"]), "\n")
    out = selected.groupBy("selection_id").agg(
        F.min("device_id").alias("device_id"), F.max("device_id").alias("_last"), F.min("start_utc_ms").alias("from_ms"),
        F.max("end_utc_ms").alias("to_ms"), text.alias("quoted_text"))
    checked = F.when(F.col("device_id") == F.col("_last"), F.col("device_id")).otherwise(
        F.raise_error(F.lit("a selection must stay on one device")))
    return out.withColumn("device_id", checked).drop("_last")


def next_playable(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, next_id): the earliest row of the next later chunk of the device that has audio.

    Rows collapse to one per chunk start first; the look-up is an as-of on mirrored time.
    """
    playable = join_chunks(rows.where("chunk_id is not null"), chunks, ["path", "start_utc_ms"]).where("chunk_path is not null")
    heads = playable.groupBy("device_id", "chunk_start_utc_ms").agg(
        F.min_by("id", F.struct("start_utc_ms", "id")).alias("next_id"))
    later = heads.select("device_id", (-F.col("chunk_start_utc_ms")).alias("_at"), "next_id")
    probes = chunks.select(F.col("id").alias("chunk_id"), "device_id", (-F.col("start_utc_ms") - 1).alias("_from"))
    return as_of(probes, later, ["device_id"], "_from", "_at", ["next_id"]).select(
        "chunk_id", F.col("hit.next_id").alias("next_id"))
