"""Which transcript rows a reader sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tags import CHANNEL_DICTATION, with_channel, with_effective

# The tag keys a reader may filter on.
RECIPIENT_KEYS = ("app", "window", "workspace", "pane", "program", "session_id")


def join_chunks(rows: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Rows left-joined to their chunk; chunk columns come back prefixed with `chunk_`.

    Rows without a chunk get a spread of negative keys, so they do not pile up on one join key.
    """
    key = F.coalesce("chunk_id", -1 - F.pmod("id", F.lit(1 << 20)))
    right = chunks.select(F.col("id").alias("_chunk_key"), F.lit(True).alias("chunk_found"),
                          *[F.col(c).alias(f"chunk_{c}") for c in columns])
    return rows.withColumn("_key", key).join(right, F.col("_key") == F.col("_chunk_key"), "left").drop(
        "_key", "_chunk_key")


def current_producer() -> Column:
    """Span rows, or rows made by the chunk's current model and revision (revision null-safe)."""
    return F.col("span_id").isNotNull() | ((F.col("model_id") == F.col("chunk_model_id")) & F.col("chunk_found")
                                           & F.col("model_revision").eqNullSafe(F.col("chunk_model_revision")))


def default_rows(rows: DataFrame, tags: DataFrame, include_dictation: bool = False) -> DataFrame:
    """List policy: not superseded, and off the dictation channel unless asked."""
    out = with_channel(rows.where("superseded_by is null"), tags)
    return out if include_dictation else out.where(F.col("channel") != CHANNEL_DICTATION)


def policy_rows(rows: DataFrame, chunks: DataFrame, tags: DataFrame, channel: str = "ambient",
                device_id: str | None = None, lang: str | None = None,
                recipients: dict[str, str] | None = None, chunk_columns: list[str] | None = None) -> DataFrame:
    """Read policy: not superseded, current producer, channel / language / recipient filters.

    Row filters come first so they reach the scan; each recipient key costs one join.
    """
    live = rows.where("superseded_by is null")
    if device_id is not None:
        live = live.where(F.col("device_id") == device_id)
    if lang is not None:
        live = live.where(F.col("lang") == lang)
    columns = ["model_id", "model_revision", *[c for c in chunk_columns or [] if c not in ("model_id", "model_revision")]]
    live = join_chunks(live, chunks, columns).where(current_producer())
    live = with_channel(live, tags)
    if channel == "ambient":
        live = live.where(F.col("channel") != CHANNEL_DICTATION)
    elif channel != "all":
        live = live.where(F.col("channel") == CHANNEL_DICTATION)
    for key, value in (recipients or {}).items():
        if key not in RECIPIENT_KEYS:
            raise ValueError(f"unknown recipient key {key}")
        live = with_effective(live, tags, key, "_recipient").where(F.col("_recipient") == value).drop("_recipient")
    return live
