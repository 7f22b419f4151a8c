"""The public queries: one function per command, tool and read route.

Arguments are clamped the way the callers expect; every function returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.checks import TARGET_LIMITS, with_target_facts
from ..functions.text import transcript_line
from ..functions.times import ms_to_iso
from ..operators import search as Q
from ..operators.intervals import overlaps_window, starts_in, touches_range
from ..operators.paging import ROW_KEY, clamp, head_and_tail, keyset_page
from ..operators.sessions import session_openings
from ..operators.tags import span_tag_map, span_tag_scope, tag_lists, with_channel
from ..operators.timeline import source_extents, timeline
from ..operators.transcripts import timing_kind, word_timing
from ..operators.visibility import default_rows, join_chunks, policy_rows, with_channel


def _iso_pair(df: DataFrame) -> DataFrame:
    return df.withColumn("start_utc", ms_to_iso("start_utc_ms")).withColumn("end_utc", ms_to_iso("end_utc_ms"))


# ------------------------------------------------------------- list tools


def search(rows: DataFrame, tags: DataFrame, query: str, from_ms: int | None = None, to_ms: int | None = None,
           device_id: str | None = None, limit: int = 10, offset: int = 0, fuzzy: bool = False,
           include_dictation: bool = False) -> DataFrame:
    """Ranked rows for a query; default visibility, filters applied after scoring."""
    found = Q.matches(rows, query, fuzzy).where(starts_in(from_ms, to_ms))
    if device_id:
        found = found.where(F.col("device_id") == device_id)
    seen = default_rows(found, tags, include_dictation)
    order = Q.ranked(seen, Q.is_scored(query, fuzzy), tie_break=False)
    return _iso_pair(seen.orderBy(*order).offset(max(0, int(offset))).limit(clamp(limit, 1, 500)))


def list_sessions(sessions: DataFrame, from_ms: int | None = None, to_ms: int | None = None,
                  device_id: str | None = None, limit: int = 50) -> DataFrame:
    """Sessions touching a range, newest first."""
    out = sessions.where(touches_range(from_ms, to_ms))
    if device_id:
        out = out.where(F.col("device_id") == device_id)
    out = out.orderBy(F.col("start_utc_ms").desc(), "session_id").limit(clamp(limit, 1, 1000))
    seconds = F.bround((F.col("end_utc_ms") - F.col("start_utc_ms")) / 1000, 3)
    return _iso_pair(out).withColumn("duration_s", seconds)


def list_spans(spans: DataFrame, span_tags: DataFrame, from_ms: int | None = None, to_ms: int | None = None,
               device_id: str | None = None, limit: int = 50) -> DataFrame:
    """Dictation spans touching a range, newest first, with their exact-range tags as a map."""
    out = spans.where(touches_range(from_ms, to_ms))
    if device_id:
        out = out.where(F.col("device_id") == device_id)
    top = out.orderBy(F.col("start_utc_ms").desc(), F.col("id").desc()).limit(clamp(limit, 1, 1000))
    return _iso_pair(span_tag_map(top, span_tags))


def session_rows(rows: DataFrame, chunk_sessions: DataFrame, tags: DataFrame, session_id: str | None = None,
                 include_dictation: bool = False) -> DataFrame:
    """Visible rows with their session (chunk_id, session_id); one session's rows come ordered."""
    wanted = chunk_sessions if session_id is None else chunk_sessions.where(F.col("session_id") == session_id)
    live = rows.join(wanted.select(F.col("id").alias("chunk_id"), "session_id"), "chunk_id")
    out = default_rows(live, tags, include_dictation)
    return out if session_id is None else out.orderBy("start_utc_ms", "chunk_id", "idx")


def get_session(session: DataFrame, rows: DataFrame, max_chars: int = 0) -> DataFrame:
    """One row per session of `session` with `n_rows` and its transcript as one text, head and tail where it is too long.

    `rows` come from `session_rows`.
    """
    lines = rows.select("session_id", "start_utc_ms", "chunk_id", "idx", transcript_line("start_utc_ms", "channel", "lang", "text").alias("line"))
    text = head_and_tail(lines, "session_id", ["start_utc_ms", "chunk_id", "idx"], "line", max_chars)
    return session.join(text, "session_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).withColumn("text", F.coalesce("text", F.lit("")))


def segment_context(rows: DataFrame, tags: DataFrame, segment_id: int, window_s: float = 60.0,
                    include_dictation: bool = False) -> DataFrame:
    """Rows of the anchor's device within a window around it, both edges closed, and the anchor.

    The anchor comes whatever its channel and status; the default filters hold for the rows around it.
    `is_anchor` marks it, `in_context` the rows that pass the filters. The anchor is one row (unique id),
    read as scalar subqueries, so the scan gets plain filters.
    """
    w = int(window_s * 1000)
    anchor = rows.where(F.col("id") == segment_id)

    def of(c: Column) -> Column:
        return anchor.select(c).scalar()

    near = rows.where((F.col("device_id") == of(F.col("device_id")))
                      & (F.col("end_utc_ms") >= of(F.col("start_utc_ms") - w))
                      & (F.col("start_utc_ms") <= of(F.col("end_utc_ms") + w)))
    shown = default_rows(near, tags, include_dictation).withColumn("in_context", F.lit(True))
    hidden = with_channel(anchor, tags).join(shown.select("id"), "id", "left_anti").withColumn("in_context", F.lit(False))
    out = shown.unionByName(hidden).withColumn("is_anchor", F.col("id") == segment_id)
    return _iso_pair(out).orderBy("start_utc_ms", "chunk_id", "idx")


# ------------------------------------------------------------- read routes


def info(chunks: DataFrame, raw: DataFrame, spans: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Known sources with extents and display labels."""
    out = source_extents(chunks, raw, spans)
    names = F.create_map(*[F.lit(x) for kv in (labels or {}).items() for x in kv]) if labels else None
    label = F.col("device_id") if names is None else F.coalesce(names[F.col("device_id")], F.col("device_id"))
    return out.withColumn("label", label)


def items(rows: DataFrame, tags: DataFrame, chunks: DataFrame, words: str | None = None,
          audio_files: DataFrame | None = None) -> DataFrame:
    """The nested output item per row: producer, timing, words, tags, chunk facts.

    `rows` are few (a page) or many (an export); nothing here depends on which. `audio_files` (path)
    lists the archive; an item has audio when its chunk's path is in it.
    """
    known = {"session_id", "status", "path", "start_utc_ms"} & set(chunks.columns)
    joined = join_chunks(rows, chunks, sorted(known))
    if "channel" not in rows.columns:
        joined = with_channel(joined, tags)
    joined = joined.join(tag_lists(tags).withColumnRenamed("segment_id", "id"), "id", "left")
    timed = (word_timing(words, "chunk_start_utc_ms", "start_utc_ms", "end_utc_ms") if words else
             F.lit(None).cast("array<struct<text:string,start_utc_ms:bigint,end_utc_ms:bigint,probability:double>>"))
    if audio_files is not None:
        have = audio_files.select(F.col("path").alias("chunk_path"), F.lit(True).alias("_have")).distinct()
        joined = joined.join(have, "chunk_path", "left")
    audio = F.coalesce("_have", F.lit(False)) if audio_files is not None else F.lit(False)

    def text_id(c: str) -> Column:
        return F.col(c).cast("string").alias("segment_id" if c == "id" else c)

    return joined.select(
        text_id("id"), text_id("chunk_id"), text_id("span_id"), "device_id", "start_utc_ms", "end_utc_ms", "text", "lang",
        "channel", (F.col("chunk_session_id") if "session_id" in known else F.lit(None).cast("string")).alias("session_id"),
        "chunk_start_utc_ms", F.col("chunk_status").alias("processing_state"),
        F.struct(F.when(F.col("span_id").isNotNull(), "dictation").otherwise("stt").alias("kind"), "model_id",
                 "model_revision").alias("producer"),
        F.lit(None).cast("string").alias("speaker"), timing_kind(timed).alias("timing"), timed.alias("words"),
        F.coalesce("tags", F.array().cast("array<struct<key:string,value:string,source:string,origin:string,effective:boolean>>"))
        .alias("tags"), audio.alias("audio_available"))


def as_json(rows: DataFrame, name: str = "item") -> DataFrame:
    """Each row as one JSON text, nulls kept."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def transcript(rows: DataFrame, chunks: DataFrame, tags: DataFrame, from_ms: int, to_ms: int,
               after: Sequence[object] | None = None, limit: int = 100, **policy) -> DataFrame:
    """A page of rows overlapping `[from, to)` under the read policy, plus one row more."""
    live = policy_rows(rows.where(overlaps_window(from_ms, to_ms)), chunks, tags, **policy)
    return keyset_page(live, ROW_KEY, after, clamp(limit, 1, 500))


def transcript_all(rows: DataFrame, chunks: DataFrame, tags: DataFrame, from_ms: int, to_ms: int, **policy) -> DataFrame:
    """The same rows without paging, for jobs."""
    return policy_rows(rows.where(overlaps_window(from_ms, to_ms)), chunks, tags, **policy)


def recall_timeline(spark: SparkSession, rows: DataFrame, chunks: DataFrame, raw: DataFrame, spans: DataFrame,
                    tags: DataFrame, from_ms: int, to_ms: int, tz: str, bucket: str = "hour",
                    device_id: str | None = None, **policy) -> DataFrame:
    seen = policy_rows(rows.where(overlaps_window(from_ms, to_ms)), chunks, tags, device_id=device_id, **policy)
    return timeline(spark, seen, chunks, raw, spans, from_ms, to_ms, tz, bucket, device_id)


def recall_sessions(sessions: DataFrame, rows: DataFrame, chunks: DataFrame, chunk_sessions: DataFrame, tags: DataFrame,
                    from_ms: int, to_ms: int, as_of_ms: int, after: Sequence[object] | None = None,
                    limit: int | None = 100, **policy) -> DataFrame:
    """Sessions overlapping a window with visible-row counts and opening lines.

    Empty sessions are kept only for the unfiltered ambient channel.
    """
    plain = policy.get("channel", "ambient") == "ambient" and not policy.get("lang") and not policy.get("recipients")
    wanted = sessions.where(overlaps_window(from_ms, to_ms))
    if policy.get("device_id"):
        wanted = wanted.where(F.col("device_id") == policy["device_id"])
    seen = policy_rows(rows, chunks, tags, **policy).join(
        chunk_sessions.select(F.col("id").alias("chunk_id"), "session_id"), "chunk_id")
    out = session_openings(wanted, seen, include_empty=plain).withColumn(
        "closed", F.lit(as_of_ms) > F.col("end_utc_ms") + F.col("gap_s") * 1000)
    if limit is None:
        return out
    return keyset_page(out, ("start_utc_ms", "device_id", "session_id"), after, clamp(limit, 1, 500))


def recall_spans(spans: DataFrame, span_tags: DataFrame, from_ms: int, to_ms: int, device_id: str | None = None,
                 lang: str | None = None, cancelled: bool | None = None, recipients: dict[str, str] | None = None,
                 after: Sequence[object] | None = None, limit: int | None = 100) -> DataFrame:
    """Reported spans in a window with target facts and the tags in their scope (tag ids in time order)."""
    out = spans.where(overlaps_window(from_ms, to_ms))
    if device_id is not None:
        out = out.where(F.col("device_id") == device_id)
    if lang is not None:
        out = out.where(F.col("lang") == lang)
    if cancelled is not None:
        out = out.where(F.col("cancelled") == cancelled)
    out = with_target_facts(out)
    for key in TARGET_LIMITS:
        value = F.col("facts")[key]
        if key in ("app", "window"):
            value = F.coalesce(F.nullif(F.col(key), F.lit("")), value)
        out = out.withColumn(f"target_{key}", value)
    out = out.drop("facts")
    for key, value in (recipients or {}).items():
        out = out.where(F.col(f"target_{key}") == value)
    if limit is not None:
        out = keyset_page(out, ROW_KEY, after, clamp(limit, 1, 500))
    scope = span_tag_scope(out, span_tags).groupBy(F.col("span_id").alias("id")).agg(
        F.sort_array(F.collect_list("tag_id")).alias("tag_ids"))
    return out.join(scope, "id", "left")


def recall_search(rows: DataFrame, chunks: DataFrame, tags: DataFrame, query: str, from_ms: int, to_ms: int,
                  fuzzy: bool = False, after: Sequence[object] | None = None, limit: int = 100, **policy) -> DataFrame:
    """A page of matches under the read policy, best first, each with its address."""
    found = Q.matches(rows, query, fuzzy).where(overlaps_window(from_ms, to_ms))
    seen = policy_rows(found, chunks, tags, **policy)
    scored = Q.is_scored(query, fuzzy)
    seen = seen.withColumn("_newest", -F.col("start_utc_ms")).withColumn("address_to_ms", Q.address_end())
    key = ("score", *ROW_KEY) if scored else ("_newest", "device_id", "id")
    if after is not None and not scored:
        after = (-int(after[0]), *after[1:])
    return keyset_page(seen, key, after, clamp(limit, 1, 500)).drop("_newest")
