"""Reported dictation spans against transcript rows and chunks.

All results are pure functions of the inputs, so a late span or a late chunk is handled by
recomputing the touched devices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import join_tokens
from .intervals import first_overlap, interval_join
from .sliced import Carry, scan, with_slice

SPAN = ("start_utc_ms", "end_utc_ms")
MIN_UNCOVERED_MS = 1000  # less audio than this outside the spans needs no transcription
SAMPLES_PER_MS = 16


def text_spans(spans: DataFrame) -> DataFrame:
    return spans.where(~F.col("cancelled"))


def superseded(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, superseded_by): each row with the first span with text, by (start, id), that overlaps it."""
    narrow = rows.select("id", "device_id", *SPAN)
    hit = first_overlap(narrow, text_spans(spans), ["device_id"], SPAN, SPAN, "id", ["id"])
    return hit.select("id", F.col("hit.id").alias("superseded_by"))


def span_rows(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Transcript rows of spans with text, attached to the first overlapping chunk if there is one."""
    live = text_spans(spans).select("id", "device_id", *SPAN, "text", "lang", "engine")
    hit = first_overlap(live, chunks, ["device_id"], SPAN, SPAN, "id", ["id", "start_utc_ms"])
    offset = F.coalesce(F.greatest(F.col("start_utc_ms") - F.col("hit.start_utc_ms"), F.lit(0)), F.lit(0))
    return hit.select(F.col("id").alias("span_id"), "device_id", F.col("hit.id").alias("chunk_id"),
                      *SPAN, offset.alias("offset_ms"), F.btrim("text").alias("text"), "lang",
                      F.col("engine").alias("model_id"))


def cancelled_tags(rows: DataFrame, spans: DataFrame, tag_pairs: DataFrame, tags: DataFrame) -> DataFrame:
    """(segment_id, key, value): tags of cancelled spans for the rows they overlap.

    A key a row already has is left alone; of several cancelled spans the first, by (start, id),
    that offers a key gives it. A row is probed once for each key that its device's spans offer (the known target
    fields, a handful), by a carried scan that emits no pairs.
    """
    gone = spans.where("cancelled").select(F.col("id").alias("_span"), "device_id",
                                           F.col("start_utc_ms").alias("_ss"), F.col("end_utc_ms").alias("_se"))
    offered = gone.join(tag_pairs.select(F.col("id").alias("_span"), "key", "value"), "_span")
    keys = offered.groupBy("device_id").agg(F.collect_set("key").alias("_keys"))
    probes = rows.join(keys, "device_id").select(F.col("id").alias("segment_id"), "device_id", F.col("start_utc_ms").alias("_rs"),
                                                 F.col("end_utc_ms").alias("_re"), F.explode("_keys").alias("key"))
    first = first_overlap(probes, offered, ["device_id", "key"], ("_rs", "_re"), ("_ss", "_se"), "_span", ["value"]).where("hit is not null")
    return first.select("segment_id", "key", "hit.value").join(tags.select("segment_id", "key"), ["segment_id", "key"], "left_anti")


def masked_ranges(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(chunk_id, span_id, lo, hi): sample ranges to silence before transcription."""
    left = chunks.select(F.col("id").alias("chunk_id"), "device_id", F.col("start_utc_ms").alias("_cs"),
                         F.col("end_utc_ms").alias("_ce"), "n_samples")
    right = text_spans(spans).select(F.col("id").alias("span_id"), "device_id", F.col("start_utc_ms").alias("_ss"),
                                     F.col("end_utc_ms").alias("_se"))
    pairs = interval_join(left, right, ["device_id"], ("_cs", "_ce"), ("_ss", "_se")).where("_cs < _se and _ce > _ss")
    lo = F.greatest(F.lit(0).cast("bigint"), (F.col("_ss") - F.col("_cs")) * SAMPLES_PER_MS)
    hi = F.least(F.col("n_samples"), (F.col("_se") - F.col("_cs")) * SAMPLES_PER_MS)
    return pairs.select("chunk_id", "span_id", lo.alias("lo"), hi.alias("hi")).where("hi > lo")


def masked_time(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, masked_ms): summed overlap of spans with text and each chunk, overlapping spans added
    up and not merged.

    No pairs: the time masked before an instant is a running sum over span edges, linear between
    them, and a chunk's value is the difference at its ends.
    """
    live = text_spans(spans).where("end_utc_ms > start_utc_ms")
    edges = live.select("device_id", F.inline(F.array(
        F.struct(F.col("start_utc_ms").alias("_at"), F.lit(1).alias("_n")),
        F.struct(F.col("end_utc_ms").alias("_at"), F.lit(-1).alias("_n")))))
    edges = edges.groupBy("device_id", "_at").agg(F.sum("_n").alias("_n"))
    probes = chunks.select("device_id", F.inline(F.array(
        F.struct(F.col("start_utc_ms").alias("_at"), F.col("id").alias("_id"), F.lit(-1).alias("_sign")),
        F.struct(F.col("end_utc_ms").alias("_at"), F.col("id").alias("_id"), F.lit(1).alias("_sign")))))
    none = F.lit(None).cast("bigint")
    both = (edges.select("device_id", "_at", F.lit(0).alias("_side"), F.col("_n").cast("bigint").alias("_n"),
                         none.alias("_id"), F.lit(0).alias("_sign"))
            .unionByName(probes.select("device_id", "_at", F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_n"),
                                       "_id", "_sign")))
    # Sum of (t - edge) * n over earlier edges = t * sum(n) - sum(edge * n).
    seen = scan(with_slice(both, "_at"), ["device_id"], ["_at", "_side", "_id", "_sign"],
                [Carry("_open", "sum", F.col("_n")), Carry("_moment", "sum", F.col("_at") * F.col("_n"))])
    value = F.col("_at") * F.col("_open") - F.col("_moment")
    return (seen.where("_side = 1").groupBy(F.col("_id").alias("id"))
            .agg(F.sum(value * F.col("_sign")).alias("masked_ms")))


def covered_chunks(chunks: DataFrame, spans: DataFrame, min_uncovered_ms: int = MIN_UNCOVERED_MS) -> DataFrame:
    """Chunks with something masked and less than `min_uncovered_ms` left to transcribe."""
    masked = masked_time(chunks, spans).where("masked_ms > 0")
    left = F.col("duration_ms") - F.col("masked_ms")
    return (chunks.select("id", "device_id", "duration_ms").join(masked, "id")
            .where(left < min_uncovered_ms).select("id", "device_id", "duration_ms", "masked_ms"))


def split_at_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows cut at span edges: (id, piece, start, end, offset_ms, text, words, superseded_by).

    `rows` has id, device_id, chunk_start_utc_ms, start/end, text and `words`
    (array of w, s, e, p in chunk-relative ms, or NULL). A word belongs to the first span holding
    its midpoint; runs of words with one owner become pieces. A row whose words have one owner is
    kept whole; without words the first overlapping span takes the whole row.
    """
    live = text_spans(spans)
    has_words = F.coalesce(F.size("words") > 0, F.lit(False))
    bare = rows.where(~has_words)
    taken = first_overlap(bare.select("id", "device_id", *SPAN), live, ["device_id"], SPAN, SPAN, "id", ["id"])
    whole = bare.join(taken.select("id", F.col("hit.id").alias("superseded_by")), "id").select(
        "id", F.lit(0).cast("bigint").alias("piece"), *SPAN,
        (F.col("start_utc_ms") - F.col("chunk_start_utc_ms")).alias("offset_ms"), "text", "words", "superseded_by")

    # Midpoints are half milliseconds, so positions are doubled.
    timed = rows.where(has_words).select("id", "device_id", "chunk_start_utc_ms", F.posexplode("words").alias("i", "w"))
    mid = 2 * F.col("chunk_start_utc_ms") + F.col("w.s") + F.col("w.e")
    probes = timed.withColumn("_m", mid).withColumn("_m1", mid + 1)
    doubled = live.select("id", "device_id", (F.col("start_utc_ms") * 2).alias("_s2"), (F.col("end_utc_ms") * 2).alias("_e2"))
    owned = first_overlap(probes, doubled, ["device_id"], ("_m", "_m1"), ("_s2", "_e2"), "id", ["id"])
    by_row = Window.partitionBy("id").orderBy("i")  # one transcript row: seconds of speech
    owner = F.col("hit.id")
    runs = (owned.withColumn("_own", owner)
            .withColumn("_new", (~F.lag("_own").over(by_row).eqNullSafe(F.col("_own")) | (F.col("i") == 0)).cast("int"))
            .withColumn("piece", F.sum("_new").over(by_row.rowsBetween(Window.unboundedPreceding, 0)) - 1))
    pieces = runs.groupBy("id", "piece").agg(
        F.sort_array(F.collect_list(F.struct("i", "w"))).alias("_ws"), F.first("_own").alias("superseded_by"))
    count = Window.partitionBy("id")
    pieces = pieces.withColumn("_n", F.count("*").over(count))
    full = pieces.join(rows.where(has_words).select("id", "chunk_start_utc_ms", *SPAN, "text", "words"), "id")
    ws = F.transform("_ws", lambda x: x["w"])
    one = F.col("_n") == 1
    first, last, base = F.element_at(ws, 1), F.element_at(ws, -1), F.col("chunk_start_utc_ms")
    cut = full.select(
        "id", "piece",
        F.when(one, F.col("start_utc_ms")).otherwise(base + first["s"]).alias("start_utc_ms"),
        F.when(one, F.col("end_utc_ms")).otherwise(base + last["e"]).alias("end_utc_ms"),
        F.when(one, F.col("start_utc_ms") - base).otherwise(first["s"]).alias("offset_ms"),
        F.when(one, F.col("text")).otherwise(join_tokens(F.transform(ws, lambda w: w["w"]))).alias("text"),
        ws.alias("words"), "superseded_by")
    return whole.unionByName(cut)


def newest_transcription(rows: DataFrame) -> DataFrame:
    """Keep, per (chunk, model), the rows of the newest transcription batch; span rows stay.

    `rows` has chunk_id, model_id, span_id and `batch`. The newest batch is an aggregate joined
    back, so a chunk transcribed many times is not ranked in one task.
    """
    stt = rows.where("span_id is null")
    newest = stt.groupBy("chunk_id", "model_id").agg(F.max("batch").alias("batch"))
    return (stt.join(newest, ["chunk_id", "model_id", "batch"], "left_semi").select(*rows.columns)
            .unionByName(rows.where("span_id is not null")))


def attempt_state(outcomes: DataFrame, max_attempts: int = 3) -> DataFrame:
    """(chunk_id, status, attempts) from an outcome log: at, chunk_id, event (ok, error, requeue).

    Attempts count errors since the last requeue; a success ends the chunk as done whatever came
    before, and a later requeue reopens it.
    """
    last = outcomes.groupBy("chunk_id").agg(F.max(F.when(F.col("event") == "requeue", F.col("at"))).alias("_reset"))
    since = outcomes.join(last, "chunk_id").where(
        F.col("_reset").isNull() | (F.col("at") > F.col("_reset")) | (F.col("event") == "requeue"))
    state = since.groupBy("chunk_id").agg(
        F.count_if(F.col("event") == "error").alias("attempts"), F.count_if(F.col("event") == "ok").alias("_ok"))
    status = (F.when(F.col("_ok") > 0, "done").when(F.col("attempts") >= max_attempts, "failed").otherwise("pending"))
    return state.select("chunk_id", status.alias("status"), F.col("attempts"))


def requeue(chunks: DataFrame, max_attempts: int = 3, failed_only: bool = False, device_id: str | None = None,
            since_ms: int | None = None) -> DataFrame:
    """Chunks with failed (and stranded pending) rows put back: status pending, attempts 0."""
    stuck = F.col("status") == "failed"
    if not failed_only:
        stuck = stuck | ((F.col("status") == "pending") & (F.col("attempts") >= max_attempts))
    if device_id is not None:
        stuck = stuck & (F.col("device_id") == device_id)
    if since_ms is not None:
        stuck = stuck & (F.col("start_utc_ms") >= since_ms)
    return (chunks.withColumn("requeued", stuck)
            .withColumn("status", F.when(F.col("requeued"), "pending").otherwise(F.col("status")))
            .withColumn("attempts", F.when(F.col("requeued"), 0).otherwise(F.col("attempts"))))
