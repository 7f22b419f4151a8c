"""Key/value facts on transcript rows and on device time ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.times import floor_div
from .intervals import BUCKET_MS, interval_join

CHANNEL_DEFAULT = "ambient"
CHANNEL_DICTATION = "dictation"


def _priority() -> Column:
    return F.struct((F.col("source") == "deterministic").alias("det"), F.col("id").alias("id"))


def effective_tags(tags: DataFrame) -> DataFrame:
    """(segment_id, key, value): the latest deterministic tag, else the latest model one.

    A max per group, so it combines before the shuffle however many tags one row carries.
    """
    return tags.groupBy("segment_id", "key").agg(F.max_by("value", _priority()).alias("value"))


def with_effective(rows: DataFrame, tags: DataFrame, key: str, name: str, default: str | None = None) -> DataFrame:
    """Add the effective value of one tag key to rows with `id`."""
    values = (effective_tags(tags.where(F.col("key") == key))
              .select(F.col("segment_id").alias("id"), F.col("value").alias(name)))
    out = rows.join(values, "id", "left")
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(default))) if default is not None else out


def with_channel(rows: DataFrame, tags: DataFrame) -> DataFrame:
    return with_effective(rows, tags, "channel", "channel", CHANNEL_DEFAULT)


def tag_flags(tags: DataFrame) -> DataFrame:
    """Every tag of a row with `effective`, true for the winner of its key.

    The winner is found by an aggregate and joined back, not by ranking a row's tags in one task.
    """
    best = tags.groupBy("segment_id", "key").agg(F.max(_priority()).alias("_best"))
    return (tags.join(best, ["segment_id", "key"])
            .withColumn("effective", (F.col("_best.id") == F.col("id")) &
                        (F.col("_best.det") == (F.col("source") == "deterministic"))).drop("_best"))


def tag_lists(tags: DataFrame) -> DataFrame:
    """One row per transcript row: its tags in priority order as an array (the output item's field)."""
    item = F.struct((F.col("source") != "deterministic").alias("late"), (-F.col("id")).alias("rank"),
                    "key", "value", "source", "origin", "effective")
    listed = F.transform(F.sort_array(F.collect_list(item)),
                         lambda t: F.struct(*[t[k].alias(k) for k in ("key", "value", "source", "origin", "effective")]))
    return tag_flags(tags).groupBy("segment_id").agg(listed.alias("tags"))


def span_tag_pairs(spans: DataFrame) -> DataFrame:
    """Long-form tags a span carries: channel, mode, target facts (map column `facts`), cancelled."""
    fixed = F.array(F.struct(F.lit("channel").alias("key"), F.lit(CHANNEL_DICTATION).alias("value")),
                    F.struct(F.lit("mode").alias("key"), F.col("mode").alias("value")))
    target = F.transform(F.map_entries("facts"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    gone = F.when(F.col("cancelled"), F.array(F.struct(F.lit("cancelled").alias("key"), F.lit("true").alias("value"))))
    empty = F.array().cast("array<struct<key:string,value:string>>")
    return spans.select("id", "device_id", "start_utc_ms", "end_utc_ms", "origin",
                        F.inline(F.concat(fixed, F.coalesce(target, empty), F.coalesce(gone, empty))))


def span_tag_map(spans: DataFrame, tags: DataFrame) -> DataFrame:
    """Deterministic tags with exactly the span's range, as a map (the last id wins per key)."""
    det = tags.where("source = 'deterministic'").groupBy("device_id", "start_utc_ms", "end_utc_ms", "key").agg(
        F.max_by("value", "id").alias("value"))
    maps = det.groupBy("device_id", "start_utc_ms", "end_utc_ms").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("tags"))
    return spans.join(maps, ["device_id", "start_utc_ms", "end_utc_ms"], "left")


def span_tag_scope(spans: DataFrame, tags: DataFrame, width: int = BUCKET_MS) -> DataFrame:
    """(span id, tag id): tags in a span's scope.

    Ranges overlap strictly; a point tag counts inside `[start, end)`; for a point span a range
    containing it counts, and an equal point does. All of these meet as closed extents, so one
    bucketed join finds them and the exact rule filters.
    """
    left = spans.select(F.col("id").alias("span_id"), "device_id", F.col("start_utc_ms").alias("_ss"),
                        F.col("end_utc_ms").alias("_se"))
    right = tags.select(F.col("id").alias("tag_id"), "device_id", "key", "value", "source",
                        F.col("start_utc_ms").alias("_ts"), F.col("end_utc_ms").alias("_te"))
    pairs = interval_join(left, right, ["device_id"], ("_ss", "_se"), ("_ts", "_te"), width)
    ss, se, ts, te = (F.col(c) for c in ("_ss", "_se", "_ts", "_te"))
    rule = (((ts < se) & (te > ss)) | ((ts == te) & (ts >= ss) & (ts < se))
            | ((ss == se) & (((ts <= ss) & (te > ss)) | ((te == ts) & (ts == ss)))))
    return pairs.where(rule).select("span_id", "tag_id", "key", "value", "source")
