"""Recogniser output to transcript rows: word mapping, filters, units."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.text import BLOCKLIST, is_boilerplate, join_tokens, strip
from ..functions.times import col


# ------------------------------------------------------------- mapping


def pick_span(t: Column, spans: Column) -> Column:
    """The span (struct off, end, ord, ...) holding `t`, else the one with the nearest edge.

    `spans` is the array of one packed window in order; its length is bounded by the packing.
    """
    inside = F.filter(spans, lambda s: (s["off"] <= t) & (t < s["end"]))
    ranked = F.transform(spans, lambda s: F.struct(
        F.least(F.abs(s["off"] - t), F.abs(s["end"] - t)).alias("d"), s["ord"].alias("o"), s.alias("s")))
    return F.coalesce(F.get(inside, F.lit(0)), F.array_min(ranked)["s"])


def pick_segment(mid: Column, segs: Column) -> Column:
    """Index of the first segment (struct start, end) whose closed extent holds `mid`, else the nearest."""
    marked = F.transform(segs, lambda s, i: F.struct(
        (~((s["start"] <= mid) & (mid <= s["end"]))).alias("out"),
        F.when((s["start"] <= mid) & (mid <= s["end"]), 0.0).otherwise(
            F.least(F.abs(s["start"] - mid), F.abs(s["end"] - mid))).alias("d"), i.alias("i")))
    return F.array_min(marked)["i"]


def relative_ms(t: Column, off: Column, duration_ms: Column) -> Column:
    ms = F.bround((t - off) * 1000, 0).cast("bigint")
    return F.greatest(F.lit(0).cast("bigint"), F.least(ms, duration_ms))


def map_to_chunks(segs: DataFrame, windows: DataFrame) -> DataFrame:
    """Recogniser segments of packed windows attributed to the chunks under them.

    `segs`: window_id, seg, start, end (seconds in the window), text, words (array of word, start,
    end, probability, or NULL). `windows`: window_id, spans (array of off, end, ord, chunk_id,
    chunk_start_utc_ms, duration_ms). Each word goes to the chunk holding its midpoint; a segment
    whose words fall into several chunks is cut between them. Blank segments are dropped.
    """
    live = segs.where(F.length(strip("text")) > 0).join(windows, "window_id")
    has_words = F.coalesce(F.size("words") > 0, F.lit(False))
    timed = live.where(has_words).select("window_id", "seg", "start", "end", "text", "spans",
                                         F.size("words").alias("_nw"), F.posexplode("words").alias("i", "w"))
    timed = timed.withColumn("sp", pick_span((F.col("w.start") + F.col("w.end")) / 2, F.col("spans"))).drop("spans")
    per_seg = Window.partitionBy("window_id", "seg").orderBy("i")  # one segment: at most a window of words
    runs = (timed.withColumn("_new", F.coalesce((F.lag("sp.ord").over(per_seg) != F.col("sp.ord")).cast("int"), F.lit(1)))
            .withColumn("piece", F.sum("_new").over(per_seg.rowsBetween(Window.unboundedPreceding, 0)) - 1))
    grouped = runs.groupBy("window_id", "seg", "piece").agg(
        F.sort_array(F.collect_list(F.struct("i", "w"))).alias("_ws"), F.first("sp").alias("sp"),
        F.first("start").alias("_ss"), F.first("end").alias("_se"), F.first("text").alias("_text"),
        F.first("_nw").alias("_nw"))
    ws = F.transform("_ws", lambda x: x["w"])
    whole = F.size("_ws") == F.col("_nw")
    start = F.when(whole, F.col("_ss")).otherwise(F.element_at(ws, 1)["start"])
    end = F.when(whole, F.col("_se")).otherwise(F.element_at(ws, -1)["end"])
    text = F.when(whole, strip("_text")).otherwise(join_tokens(F.transform(ws, lambda w: w["word"])))
    out_words = F.transform(ws, lambda w: F.struct(
        w["word"].alias("w"), relative_ms(w["start"], F.col("sp.off"), F.col("sp.duration_ms")).alias("s"),
        relative_ms(w["end"], F.col("sp.off"), F.col("sp.duration_ms")).alias("e"), w["probability"].alias("p")))
    with_words = grouped.select("window_id", "seg", "piece", "sp", start.alias("_a"), end.alias("_b"),
                                text.alias("text"), out_words.alias("words"))
    plain = live.where(~has_words).select(
        "window_id", "seg", F.lit(0).cast("bigint").alias("piece"),
        pick_span((F.col("start") + F.col("end")) / 2, F.col("spans")).alias("sp"),
        F.col("start").alias("_a"), F.col("end").alias("_b"), strip("text").alias("text"),
        F.lit(None).cast(with_words.schema["words"].dataType).alias("words"))
    both = with_words.unionByName(plain)
    off = relative_ms(F.col("_a"), F.col("sp.off"), F.col("sp.duration_ms"))
    off_end = F.greatest(off, relative_ms(F.col("_b"), F.col("sp.off"), F.col("sp.duration_ms")))
    return both.select("window_id", "seg", "piece", F.col("sp.chunk_id").alias("chunk_id"),
                       (F.col("sp.chunk_start_utc_ms") + off).alias("start_utc_ms"),
                       (F.col("sp.chunk_start_utc_ms") + off_end).alias("end_utc_ms"),
                       off.alias("offset_ms"), "text", "words")


def renumber(rows: DataFrame) -> DataFrame:
    """`idx` inside a chunk in (start, end) order. A chunk is at most half a minute of speech."""
    w = Window.partitionBy("chunk_id").orderBy("start_utc_ms", "end_utc_ms", "seg", "piece")
    return rows.withColumn("idx", F.row_number().over(w) - 1)


# ------------------------------------------------------------- filters


def keep_row(min_avg_logprob: float | None = -1.0, max_compression_ratio: float | None = 2.4,
             max_no_speech_prob: float | None = 0.6, blocklist=BLOCKLIST) -> Column:
    """Quality predicate: a statistic that was not reported passes."""
    ok = F.length(strip("text")) > 0
    if min_avg_logprob is not None:
        ok = ok & (F.col("avg_logprob").isNull() | (F.col("avg_logprob") >= min_avg_logprob))
    if max_compression_ratio is not None:
        ok = ok & (F.col("compression_ratio").isNull() | (F.col("compression_ratio") <= max_compression_ratio))
    if max_no_speech_prob is not None:
        ok = ok & (F.col("no_speech_prob").isNull() | (F.col("no_speech_prob") <= max_no_speech_prob))
    return ok & ~is_boilerplate("text", blocklist)


def dropped_counts(rows: DataFrame, **limits) -> DataFrame:
    """(chunk_id, n_dropped) for chunks that lost rows to the filter."""
    return rows.where(~keep_row(**limits)).groupBy("chunk_id").agg(F.count("*").alias("n_dropped"))


# ------------------------------------------------------------- word timing and units


def word_timing(words: Column | str, base_ms: Column | str, start_ms: Column | str, end_ms: Column | str) -> Column:
    """Absolute word times, or NULL when the list is empty or any word is out of order or range.

    `words` is an array of struct w, s, e, p in chunk-relative ms.
    """
    words, base = col(words), col(base_ms)
    state = F.struct(F.lit(True).alias("ok"), col(start_ms).alias("prev"))

    def step(acc: Column, w: Column) -> Column:
        a, b = w["s"] + base, w["e"] + base
        fine = (w["w"].isNotNull() & w["s"].isNotNull() & w["e"].isNotNull() & (acc["prev"] <= a) & (a <= b)
                & (b <= col(end_ms)) & (w["p"].isNull() | ((w["p"] >= 0) & (w["p"] <= 1))))
        return F.struct((acc["ok"] & F.coalesce(fine, F.lit(False))).alias("ok"), F.coalesce(b, acc["prev"]).alias("prev"))

    valid = F.aggregate(words, state, step)["ok"]
    absolute = F.transform(words, lambda w: F.struct(
        w["w"].alias("text"), (w["s"] + base).alias("start_utc_ms"), (w["e"] + base).alias("end_utc_ms"),
        w["p"].alias("probability")))
    return F.when((F.size(words) > 0) & base.isNotNull() & valid, absolute)


def timing_kind(timed: Column) -> Column:
    return F.when(timed.isNotNull(), "word").otherwise("segment")


UNIT = "struct<text:string,start_utc_ms:bigint,end_utc_ms:bigint,kind:string>"


def aligned_units(rows: DataFrame, text: str = "text", words: str = "words", start_ms: str = "start_utc_ms",
                  end_ms: str = "end_utc_ms") -> DataFrame:
    """Add `units`: a row's words placed on its text with the text between them kept, or the row.

    `words` is what `word_timing` gives (NULL without valid timing). Each unit's text runs from the
    end of the previous unit to the end of its own token; the last one takes the rest. One misplaced
    token, or text left over, falls back to one segment unit.
    """
    body = F.col(text)
    placed = rows.withColumn("_cuts", _place_words(body, F.transform(words, lambda w: strip(w["text"]))))

    def unit(w: Column, i: Column) -> Column:
        lo = F.coalesce(F.get(F.col("_cuts"), i - 1), F.lit(0))
        piece = F.call_function("substr", body, lo + 1, F.get(F.col("_cuts"), i) - lo)
        return F.struct(piece.alias("text"), w["start_utc_ms"].alias("start_utc_ms"), w["end_utc_ms"].alias("end_utc_ms"),
                        F.lit("word").alias("kind"))

    whole = F.array(F.struct(body.alias("text"), F.col(start_ms).alias("start_utc_ms"), F.col(end_ms).alias("end_utc_ms"),
                             F.lit("segment").alias("kind")).cast(UNIT))
    units = F.when(F.col("_cuts").isNotNull(), F.transform(words, unit).cast(f"array<{UNIT}>")).otherwise(whole)
    return placed.withColumn("units", units).drop("_cuts")


@F.pandas_udf(ArrayType(IntegerType()))
def _place_words(text: pd.Series, tokens: pd.Series) -> pd.Series:
    """Where the piece of each token ends, of tokens that follow each other with nothing but white space between, the
    last one at the end of the text; NULL when they do not. A piece begins where the one before ends."""
    def one(body, toks):
        if toks is None or len(toks) == 0:
            return None
        out, at = np.empty(len(toks), np.int32), 0
        for k, tok in enumerate(toks):
            here = at
            while here < len(body) and body[here].isspace():
                here += 1
            if not tok or not body.startswith(tok, here):
                return None
            at = out[k] = here + len(tok)
        if body[at:].strip():
            return None
        out[-1] = len(body)
        return out

    return pd.Series([one(b, t) for b, t in zip(text, tokens)], dtype=object)
