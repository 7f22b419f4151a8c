"""Projections of the given tables onto the speech-log schemas.

Every view is a plain projection, so filters and column pruning reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.times import archive_path, ntz_to_ms
from ..session import configure

BASE_MS = 1_704_067_200_000  # 2024-01-01T00:00:00Z, where the event table starts
AS_OF_MS = 1_706_659_200_000  # 2024-01-31T00:00:00Z
GAP_S = 14_400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """Columns behind a one-row generator, as if stored: lambdas over them read values and do not
    evaluate the view's expressions once per element."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = ntz_to_ms("ts")
    return e.select(
        "event_id", "user_id", "event_type", "value", "props",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("device_id"),
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"),
        (F.col("user_id") % 3).alias("epoch"),
        start.alias("start_utc_ms"),
        F.round(F.col("value") * 60000).cast("bigint").alias("duration_ms"),
    ).withColumn("end_utc_ms", F.col("start_utc_ms") + F.col("duration_ms"))


def _sha(prefix: str) -> Column:
    return F.sha2(F.concat(F.lit(prefix), F.col("event_id").cast("string")), 256)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    status = (F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "pending")
              .otherwise("done"))
    received = F.col("end_utc_ms") + 1000 * (F.col("event_id") % 7)
    sha = _sha("e")
    return e.select(
        F.col("event_id").alias("id"), sha.alias("sha256"),
        F.when(F.col("event_type") == "view", "derived").otherwise("speech").alias("kind"),
        "device_id", "start_utc_ms", "end_utc_ms", "duration_ms",
        F.when(F.col("event_id") % 5 != 0, archive_path("start_utc_ms", sha)).alias("path"),
        "run_id", "epoch",
        ((F.col("start_utc_ms") - BASE_MS) * 16).alias("n_start"), (F.col("duration_ms") * 16).alias("n_samples"),
        received.alias("received_utc_ms"), status.alias("status"),
        (F.col("event_id") % 4).cast("int").alias("attempts"),
        F.when(status == "done", received + 5000).alias("transcribed_utc_ms"),
        F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")).alias("model_id"),
        F.when(F.col("event_id") % 5 != 0, "r1").alias("model_revision"),
    )


def raw_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where(F.col("event_type").isin("view", "error"))
    return e.select(
        F.col("event_id").alias("id"), _sha("w").alias("sha256"), "device_id", "run_id", "epoch",
        ((F.col("start_utc_ms") - BASE_MS) * 16).alias("n_start"), (F.col("duration_ms") * 16).alias("n_samples"),
        "start_utc_ms", (F.col("end_utc_ms") + 1000).alias("received_utc_ms"),
        F.when(F.col("event_type") == "view", "segmented").otherwise("pending").alias("status"),
    )


def dictation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where(F.col("event_type") == "purchase")
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"target":{"app":"app'), k, F.lit('","window":'), k, F.lit(',"pane":"p'), k,
                    F.lit('","program":""}}'))
    return e.select(
        F.col("event_id").alias("id"), "device_id", "start_utc_ms", "end_utc_ms",
        F.concat(F.lit("span "), F.col("event_id").cast("string")).alias("text"),
        F.when(F.col("event_id") % 3 == 0, "no").otherwise("en").alias("lang"),
        F.lit("engine-a").alias("engine"),
        F.when(F.col("event_id") % 2 == 0, "raw").otherwise("cleanup").alias("mode"),
        F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.lit(None).cast("string")).alias("app"),
        F.lit(None).cast("string").alias("window"),
        (F.col("event_id") % 5 == 0).alias("cancelled"), F.lit("tool").alias("origin"), body.alias("body_json"),
        (F.col("end_utc_ms") + 2000).alias("received_utc_ms"),
        F.when(F.col("event_id") % 7 == 0, "pending").otherwise("applied").alias("status"),
    )


def stt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript rows on the event timeline: one per non-purchase event, chunk = its own event."""
    e = _events(spark, sf_dir).where(F.col("event_type") != "purchase")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_id").alias("chunk_id"), "device_id",
        "start_utc_ms", "end_utc_ms",
        F.concat_ws(" ", "event_type", F.col("user_id").cast("string"), F.lit("row"),
                    F.col("event_id").cast("string")).alias("text"),
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    source = F.when(F.col("event_id") % 3 == 0, "deterministic").otherwise("model").alias("source")
    channel = e.select(F.col("event_id").alias("id"), (F.col("event_id") % 997).alias("segment_id"),
                       F.lit("channel").alias("key"),
                       F.when(F.col("event_id") % 4 == 0, "dictation").otherwise("ambient").alias("value"),
                       source, F.lit("tool").alias("origin"))
    app = e.select((F.col("event_id") + 1_000_000_000_000).alias("id"), (F.col("event_id") % 997).alias("segment_id"),
                   F.lit("app").alias("key"),
                   F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("value"), source,
                   F.lit("tool").alias("origin"))
    return channel.unionByName(app)


def span_tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags on device time ranges: the ranges of view events, points for clicks."""
    e = _events(spark, sf_dir).where(F.col("event_type").isin("view", "click", "purchase"))
    return e.select(
        F.col("event_id").alias("id"), "device_id", "start_utc_ms",
        F.when(F.col("event_type") == "click", F.col("start_utc_ms")).otherwise(F.col("end_utc_ms")).alias("end_utc_ms"),
        F.when(F.col("event_id") % 2 == 0, "app").otherwise("mode").alias("key"),
        F.concat(F.lit("v"), (F.col("event_id") % 10).cast("string")).alias("value"),
        F.when(F.col("event_id") % 3 == 0, "model").otherwise("deterministic").alias("source"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as transcript rows; turn 7 is a point row, two turns share a chunk."""
    c = table(spark, sf_dir, "conversations")
    turn, conv = F.col("turn"), F.col("conv_id")
    start = F.lit(BASE_MS) + conv * 600_000 + turn * 20_000
    ident = conv * 8 + turn
    return c.select(
        ident.alias("id"), F.when(ident % 11 != 5, conv * 8 + (turn - turn % 2)).alias("chunk_id"),
        F.concat(F.lit("u"), (conv % 20).cast("string")).alias("device_id"),
        F.when(ident % 11 == 0, ident).alias("span_id"), F.when(ident % 13 == 0, conv).alias("superseded_by"),
        (turn % 2).alias("idx"), start.alias("start_utc_ms"),
        F.when(turn == 7, start).otherwise(start + F.least(F.lit(15_000), F.length("text") * 50)).alias("end_utc_ms"),
        "text", F.when(conv % 3 == 0, "no").otherwise("en").alias("lang"),
        F.concat(F.lit("m"), (conv % 2).cast("string")).alias("model_id"),
        F.when(conv % 4 != 0, F.concat(F.lit("r"), (turn % 4).cast("string"))).alias("model_revision"),
        "role", "conv_id", "turn",
    )


def segment_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks under `segments`: one per two turns."""
    c = table(spark, sf_dir, "conversations").where(F.col("turn") % 2 == 0)
    turn, conv = F.col("turn"), F.col("conv_id")
    start = F.lit(BASE_MS) + conv * 600_000 + turn * 20_000
    return c.select(
        (conv * 8 + turn).alias("id"), F.concat(F.lit("u"), (conv % 20).cast("string")).alias("device_id"),
        start.alias("start_utc_ms"), (start + 39_000).alias("end_utc_ms"),
        F.concat(F.lit("m"), (conv % 2).cast("string")).alias("model_id"),
        F.when(conv % 4 != 0, F.concat(F.lit("r"), (turn % 4).cast("string"))).alias("model_revision"),
        F.when(conv % 9 == 0, "pending").otherwise("done").alias("status"),
        F.when(conv % 5 != 0, F.concat(F.lit("a/"), (conv * 8 + turn).cast("string"), F.lit(".opus"))).alias("path"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`segments` with their white-space tokens, the token count and the length in ms."""
    s = settled(segments(spark, sf_dir))
    tokens = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    return settled(s.withColumn("tokens", tokens).withColumn("n_tokens", F.size("tokens").cast("bigint"))
            .withColumn("n_ms", F.col("end_utc_ms") - F.col("start_utc_ms")))


def search_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), "text", "lang",
                    F.concat(F.lit("u"), (F.col("doc_id") % 20).cast("string")).alias("device_id"),
                    (F.lit(BASE_MS) + F.col("doc_id") * 1000).alias("start_utc_ms"),
                    (F.lit(BASE_MS) + F.col("doc_id") * 1000 + (F.col("doc_id") % 4) * 500).alias("end_utc_ms"),
                    F.when(F.col("doc_id") % 17 == 0, F.lit(1)).alias("superseded_by"))


def mapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript rows with recogniser statistics for the quality filters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("chunk_id"), "text",
        (F.col("quality") - 1.5).alias("avg_logprob"), (F.col("toxic") * 0.9).alias("no_speech_prob"),
        F.when(F.col("doc_id") % 10 == 0, F.lit(2.5)).when(F.col("doc_id") % 10 < 5, F.lit(1.2))
        .alias("compression_ratio"))
