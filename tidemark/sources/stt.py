"""Recogniser responses (JSON text) to segments with words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.transcripts import pick_segment

WORD = "struct<start:double,end:double,word:string,probability:double,score:double>"
VERBOSE = ("struct<text:string,duration:double,language:string,words:array<" + WORD + ">,"
           "segments:array<struct<start:double,end:double,text:string,avg_logprob:double,compression_ratio:double,"
           "no_speech_prob:double,words:array<" + WORD + ">>>>")
CENTI = ("struct<text:string,duration:double,language:string,"
         "segments:array<struct<start:double,end:double,t0:double,t1:double,text:string,avg_logprob:double,"
         "compression_ratio:double,no_speech_prob:double>>>")
OUT_WORD = "array<struct<word:string,start:double,end:double,probability:double>>"


def _segment(start: Column, end: Column, text: Column, src: Column | None) -> Column:
    def stat(name: str) -> Column:
        return (F.lit(None).cast("double") if src is None else src[name]).alias(name)

    return F.struct(start.alias("start"), end.alias("end"), F.coalesce(text, F.lit("")).alias("text"),
                    stat("avg_logprob"), stat("compression_ratio"), stat("no_speech_prob"))


def _words(raw: Column) -> Column:
    timed = F.filter(raw, lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    return F.transform(timed, lambda w: F.struct(
        F.coalesce(w["word"], F.lit("")).alias("word"), w["start"].alias("start"), w["end"].alias("end"),
        F.coalesce(w["probability"], w["score"]).alias("probability")))


def _or_whole_text(segments: Column, body: Column) -> Column:
    whole = F.array(_segment(F.lit(0.0), F.coalesce(body["duration"], F.lit(0.0)), body["text"], None))
    empty = F.coalesce(F.size(segments) <= 0, F.lit(True))
    return F.when(empty & (F.length(body["text"]) > 0), whole).otherwise(F.coalesce(segments, F.array().cast(
        "array<struct<start:double,end:double,text:string,avg_logprob:double,compression_ratio:double,no_speech_prob:double>>")))


def verbose_segments(responses: DataFrame) -> DataFrame:
    """(window_id, seg, start, end, text, stats, language, words) of verbose JSON responses.

    Words come flat, and go to the segment holding their midpoint or the nearest one, or nested
    under the segments. A response with a text alone is one segment. `words` is NULL without any.
    """
    body = responses.select("window_id", F.from_json("response", VERBOSE).alias("b"))
    segs = F.transform(F.col("b.segments"), lambda s: _segment(s["start"], s["end"], s["text"], s))
    flat = body.select("window_id", F.col("b.language").alias("language"), F.col("b.segments").alias("_raw"),
                       _or_whole_text(segs, F.col("b")).alias("segs"),
                       F.coalesce(_words(F.col("b.words")), F.array().cast(OUT_WORD)).alias("flat"))
    homed = F.transform("flat", lambda w: F.struct(
        pick_segment((w["start"] + w["end"]) / 2, F.col("segs")).alias("home"), w.alias("w")))
    out = flat.withColumn("homed", homed).select(
        "window_id", "language", "_raw", "flat", "homed", F.posexplode("segs").alias("seg", "s"))
    mine = F.transform(F.filter("homed", lambda h: h["home"] == F.col("seg")), lambda h: h["w"])
    nested = F.coalesce(_words(F.get("_raw", F.col("seg"))["words"]), F.array().cast(OUT_WORD))
    words = F.when(F.size("flat") > 0, mine).otherwise(nested)
    return out.select("window_id", "seg", "s.*", "language", F.when(F.size(words) > 0, words).alias("words"))


def centisecond_segments(responses: DataFrame) -> DataFrame:
    """Segments of responses that give seconds or `t0`/`t1` in hundredths; never any words."""
    body = responses.select("window_id", F.from_json("response", CENTI).alias("b"))

    def one(s: Column) -> Column:
        timed = s["start"].isNotNull() & s["end"].isNotNull()
        return _segment(F.when(timed, s["start"]).otherwise(F.coalesce(s["t0"], F.lit(0.0)) / 100),
                        F.when(timed, s["end"]).otherwise(F.coalesce(s["t1"], F.lit(0.0)) / 100), s["text"], s)

    segs = _or_whole_text(F.transform(F.col("b.segments"), one), F.col("b"))
    return body.select("window_id", F.col("b.language").alias("language"), F.posexplode(segs).alias("seg", "s")).select(
        "window_id", "seg", "s.*", "language")
