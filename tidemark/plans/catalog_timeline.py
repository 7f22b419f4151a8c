"""Queries: sessions, intervals, calendar, timeline, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times as T
from ..operators import audio as A
from ..operators import folds as L
from ..operators import intervals as I
from ..operators import paging as P
from ..operators import reports as R
from ..operators import sessions as S
from ..operators import timeline as TL
from . import views as V
from .check_views import compact, iso
from .registry import query

BASE, AS_OF = V.BASE_MS, V.AS_OF_MS


def _dense(spark, d):
    """Chunks with the clock sped up a thousandfold, so pauses and lengths are seconds."""
    c = V.chunks(spark, d)
    start = F.lit(BASE) + T.floor_div(F.col("start_utc_ms") - BASE, 1000)
    return (c.withColumn("start_utc_ms", start).withColumn("duration_ms", T.floor_div("duration_ms", 1000))
            .withColumn("end_utc_ms", F.col("start_utc_ms") + F.col("duration_ms")))


def _sessions(spark, d):
    return S.sessions_by_gap(V.chunks(spark, d), V.GAP_S, AS_OF)


# ------------------------------------------------------------- sessions


@query("sessions_by_gap", f"""
SELECT session_id, device_id, start_utc_ms, end_utc_ms, n_chunks, {AS_OF} - end_utc_ms > 14400000 AS closed FROM v_sessions""")
def sessions_by_gap(spark, d):
    return _sessions(spark, d).drop("gap_s")


@query("sessions_max_end", """
SELECT device_id, min(start_utc_ms) AS start_utc_ms, max(end_utc_ms) AS end_utc_ms, count(*) AS n_chunks FROM (
  SELECT *, sum(f) OVER (PARTITION BY device_id ORDER BY start_utc_ms, id ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN start_utc_ms - max(end_utc_ms) OVER (PARTITION BY device_id ORDER BY start_utc_ms, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 14400000 THEN 0 ELSE 1 END AS f FROM v_chunks)) GROUP BY device_id, g""")
def sessions_max_end(spark, d):
    return S.sessions_by_gap(V.chunks(spark, d), V.GAP_S, mode="max_end").select(
        "device_id", "start_utc_ms", "end_utc_ms", "n_chunks")


@query("session_preview", """
SELECT device_id, min(start_utc_ms) AS start_utc_ms, max(end_utc_ms) AS end_utc_ms, count(*) AS n_chunks FROM (
  SELECT *, sum(f) OVER (PARTITION BY device_id ORDER BY start_utc_ms, id ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN start_utc_ms - max(end_utc_ms) OVER (PARTITION BY device_id ORDER BY start_utc_ms, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 14400000 THEN 0 ELSE 1 END AS f FROM v_chunks)) GROUP BY device_id, g""")
def session_preview(spark, d):
    from ..streaming.sessions import session_windows
    return session_windows(V.chunks(spark, d), V.GAP_S)


@query("session_assign", f"""
SELECT id, device_id || '_' || {compact('min(start_utc_ms) OVER (PARTITION BY device_id, g)')} AS session_id FROM (
  SELECT *, sum(f) OVER (PARTITION BY device_id ORDER BY start_utc_ms, id ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN start_utc_ms - lag(end_utc_ms) OVER (PARTITION BY device_id ORDER BY start_utc_ms, id) <= 14400000
      THEN 0 ELSE 1 END AS f FROM v_chunks))""")
def session_assign(spark, d):
    return S.assign_sessions(V.chunks(spark, d), V.GAP_S)


@query("session_row_counts", """
SELECT ss.session_id, count(DISTINCT ss.id) AS n_chunks, count(s.id) AS n_segments FROM v_seg_sessions ss
LEFT JOIN v_segments s ON s.chunk_id = ss.id AND s.superseded_by IS NULL GROUP BY ss.session_id""")
def session_row_counts(spark, d):
    out = S.sessions_by_gap(V.segment_chunks(spark, d), 300.0, AS_OF, V.segments(spark, d))
    return out.select("session_id", "n_chunks", "n_segments")


@query("session_list", f"""
SELECT session_id, device_id, {iso('start_utc_ms')} AS start_utc, {iso('end_utc_ms')} AS end_utc,
  round((end_utc_ms - start_utc_ms) / 1000.0, 3) AS duration_s, n_chunks FROM v_sessions
WHERE end_utc_ms >= {BASE + 86_400_000} AND start_utc_ms < {BASE + 20 * 86_400_000}
ORDER BY start_utc_ms DESC, session_id LIMIT 50""")
def session_list(spark, d):
    from . import surface
    out = surface.list_sessions(_sessions(spark, d), BASE + 86_400_000, BASE + 20 * 86_400_000, limit=50)
    return out.select("session_id", "device_id", "start_utc", "end_utc", "duration_s", "n_chunks")


# ------------------------------------------------------------- interval algebra


_UNION = """
SELECT {k}, min({s}) AS {s}, max({e}) AS {e} FROM (
  SELECT *, sum(f) OVER (PARTITION BY {k} ORDER BY {s}, {e} ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT {k}, {s}, {e}, CASE WHEN {s} <= max({e}) OVER (PARTITION BY {k} ORDER BY {s}, {e}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM (SELECT DISTINCT {k}, {s}, {e} FROM {t} WHERE {e} > {s}) t)) GROUP BY {k}, g"""


def union_sql(table: str, keys: str = "device_id", s: str = "start_utc_ms", e: str = "end_utc_ms") -> str:
    return _UNION.format(t=table, k=keys, s=s, e=e)


@query("interval_union", union_sql("v_chunks"))
def interval_union(spark, d):
    return I.union(V.chunks(spark, d), ["device_id"])


@query("interval_subtract", f"""
WITH a AS ({union_sql('(SELECT * FROM v_chunks WHERE kind = ' + "'derived'" + ')')}),
b AS ({union_sql('v_spans')}),
gaps AS (
  SELECT device_id, end_utc_ms AS g0, coalesce(lead(start_utc_ms) OVER (PARTITION BY device_id ORDER BY start_utc_ms), 9e15::BIGINT) AS g1 FROM b
  UNION ALL SELECT device_id, 0, min(start_utc_ms) FROM b GROUP BY device_id
  UNION ALL SELECT device_id, 0, 9e15::BIGINT FROM (SELECT DISTINCT device_id FROM a) x WHERE device_id NOT IN (SELECT device_id FROM b))
SELECT a.device_id, greatest(a.start_utc_ms, g0) AS start_utc_ms, least(a.end_utc_ms, g1) AS end_utc_ms
FROM a JOIN gaps g ON g.device_id = a.device_id AND a.start_utc_ms < g1 AND a.end_utc_ms > g0""")
def interval_subtract(spark, d):
    return I.subtract(V.chunks(spark, d).where("kind = 'derived'"), V.dictation_spans(spark, d), ["device_id"])


@query("interval_clip", f"""
WITH u AS ({union_sql('v_chunks')}), b AS (SELECT {BASE} + i * 86400000 AS bucket_from, {BASE} + (i + 1) * 86400000 AS bucket_to FROM range(0, 40) t(i))
SELECT device_id, bucket_from, bucket_to, CAST(sum(least(end_utc_ms, bucket_to) - greatest(start_utc_ms, bucket_from)) AS BIGINT) AS covered_ms
FROM u JOIN b ON start_utc_ms < bucket_to AND end_utc_ms > bucket_from GROUP BY ALL""")
def interval_clip(spark, d):
    days = spark.range(40).select((BASE + F.col("id") * 86_400_000).alias("bucket_from"),
                                  (BASE + (F.col("id") + 1) * 86_400_000).alias("bucket_to"))
    return I.clipped_totals(V.chunks(spark, d), F.broadcast(days), ["device_id"])


@query("coverage_check", f"""
WITH u AS ({union_sql('v_chunks')})
SELECT s.id, EXISTS (SELECT 1 FROM u WHERE u.device_id = s.device_id AND u.start_utc_ms <= s.start_utc_ms AND u.end_utc_ms >= s.end_utc_ms)
  OR s.end_utc_ms <= s.start_utc_ms AS is_covered
FROM (SELECT id, device_id, start_utc_ms - 600000 AS start_utc_ms, end_utc_ms FROM v_spans) s""")
def coverage_check(spark, d):
    targets = V.dictation_spans(spark, d).select("id", "device_id", (F.col("start_utc_ms") - 600_000).alias("lo"),
                                                 F.col("end_utc_ms").alias("hi"))
    return I.coverage(targets, V.chunks(spark, d), ["device_id"], "lo", "hi", "start_utc_ms", "end_utc_ms",
                      I.SLICE_MS).select("id", "is_covered")


@query("contiguity_chains", """
SELECT id, min(n_start) OVER (PARTITION BY device_id, run_id, epoch, g) AS chain_start FROM (
  SELECT *, sum(f) OVER (PARTITION BY device_id, run_id, epoch ORDER BY n_start, id ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN n_start = lag(n_start + n_samples) OVER (PARTITION BY device_id, run_id, epoch ORDER BY n_start, id)
      THEN 0 ELSE 1 END AS f FROM (
        SELECT id, device_id, run_id, epoch, (n_start // 20000000) * 480000 AS n_start, 480000 AS n_samples FROM v_raw)))""")
def contiguity_chains(spark, d):
    grid = V.raw_segments(spark, d).select(
        "id", *A.EPOCH, (T.floor_div("n_start", 20_000_000) * 480_000).alias("n_start"),
        F.lit(480_000).cast("bigint").alias("n_samples"))
    return A.contiguity_chains(grid).select("id", "chain_start")


@query("overlap_dedupe", """
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY device_id, run_id, epoch ORDER BY n_start, id) AS rn FROM v_raw),
w AS (SELECT device_id, run_id, epoch, id, rn, n_start + n_samples AS reach, TRUE AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.device_id, o.run_id, o.epoch, o.id, o.rn,
    CASE WHEN o.n_start < w.reach THEN w.reach ELSE o.n_start + o.n_samples END, o.n_start >= w.reach
  FROM w JOIN o ON o.device_id = w.device_id AND o.run_id = w.run_id AND o.epoch = w.epoch AND o.rn = w.rn + 1)
SELECT id FROM w WHERE kept""")
def overlap_dedupe(spark, d):
    return L.drop_overlaps(V.raw_segments(spark, d), A.EPOCH).select("id")


@query("covering_raw", """
WITH RECURSIVE c AS (SELECT id, device_id, run_id, epoch, n_start, n_start + n_samples AS n_end FROM v_chunks WHERE kind = 'derived'),
p AS (SELECT c.id, r.id AS raw_id, r.n_start AS a, r.n_start + r.n_samples AS b,
    row_number() OVER (PARTITION BY c.id ORDER BY r.n_start, r.id) AS rn
  FROM c JOIN v_raw r ON r.device_id = c.device_id AND r.run_id = c.run_id AND r.epoch = c.epoch
    AND r.n_start < c.n_end AND r.n_start + r.n_samples > c.n_start AND r.status <> 'failed'),
w AS (SELECT id, raw_id, rn, b AS reach, TRUE AS kept FROM p WHERE rn = 1
  UNION ALL SELECT p.id, p.raw_id, p.rn, CASE WHEN p.a < w.reach THEN w.reach ELSE p.b END, p.a >= w.reach
  FROM w JOIN p ON p.id = w.id AND p.rn = w.rn + 1)
SELECT id, raw_id FROM w WHERE kept""")
def covering_raw(spark, d):
    found = A.covering_raw(V.chunks(spark, d).where("kind = 'derived'"), V.raw_segments(spark, d))
    return found.select("id", F.explode("covering.raw_id").alias("raw_id"))


@query("raw_coverage", "SELECT id, is_covered FROM v_coverage")
def raw_coverage(spark, d):
    return A.raw_coverage(V.chunks(spark, d).where("kind = 'derived'"), V.raw_segments(spark, d))


@query("free_stretches", f"""
WITH a AS ({union_sql('(SELECT device_id, n_start AS lo, n_start + n_samples AS hi FROM v_raw)', 'device_id', 'lo', 'hi')}),
b AS ({union_sql('(SELECT device_id, n_start AS lo, n_start + n_samples AS hi FROM v_chunks WHERE kind = ' + "'derived'" + ')', 'device_id', 'lo', 'hi')}),
gaps AS (
  SELECT device_id, hi AS g0, coalesce(lead(lo) OVER (PARTITION BY device_id ORDER BY lo), 9e17::BIGINT) AS g1 FROM b
  UNION ALL SELECT device_id, -1, min(lo) FROM b GROUP BY device_id
  UNION ALL SELECT device_id, -1, 9e17::BIGINT FROM (SELECT DISTINCT device_id FROM a) x WHERE device_id NOT IN (SELECT device_id FROM b))
SELECT a.device_id, greatest(a.lo, g0) AS lo, least(a.hi, g1) AS hi FROM a JOIN gaps g ON g.device_id = a.device_id AND a.lo < g1 AND a.hi > g0""")
def free_stretches(spark, d):
    return A.free_stretches(V.raw_segments(spark, d), V.chunks(spark, d).where("kind = 'derived'")).select("device_id", "lo", "hi")


@query("retention_anti", f"""
SELECT r.id, r.device_id, r.start_utc_ms FROM v_raw r WHERE start_utc_ms < {AS_OF - 10 * 86_400_000}
AND received_utc_ms < {AS_OF - 10 * 86_400_000} AND NOT EXISTS (SELECT 1 FROM v_chunks c WHERE c.device_id = r.device_id AND c.run_id = r.run_id
  AND c.epoch = r.epoch AND c.kind = 'derived' AND c.n_start < r.n_start + r.n_samples AND c.n_start + c.n_samples > r.n_start)""")
def retention_anti(spark, d):
    # Every raw row counts as segmented; those of errors gave no derived chunk, so some are unreferenced.
    raw = V.raw_segments(spark, d).withColumn("status", F.lit("segmented"))
    return A.purgeable_raw(raw, V.chunks(spark, d), AS_OF, 10).select("id", "device_id", "start_utc_ms")


QUERIES_SQL_PACK = """
po AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY start_utc_ms, id) AS rn,
    start_utc_ms - lag(end_utc_ms) OVER (PARTITION BY device_id ORDER BY start_utc_ms, id) AS pause FROM v_dense),
pk AS (SELECT device_id, id, rn, id AS window_id, 0::BIGINT AS offset_ms, duration_ms AS used, 0 AS ord, start_utc_ms, duration_ms FROM po WHERE rn = 1
  UNION ALL SELECT o.device_id, o.id, o.rn,
    CASE WHEN o.pause <= 300000 AND w.used + 300 + o.duration_ms <= 30000 THEN w.window_id ELSE o.id END,
    CASE WHEN o.pause <= 300000 AND w.used + 300 + o.duration_ms <= 30000 THEN w.used + 300 ELSE 0 END,
    CASE WHEN o.pause <= 300000 AND w.used + 300 + o.duration_ms <= 30000 THEN w.used + 300 + o.duration_ms ELSE o.duration_ms END,
    CASE WHEN o.pause <= 300000 AND w.used + 300 + o.duration_ms <= 30000 THEN w.ord + 1 ELSE 0 END, o.start_utc_ms, o.duration_ms
  FROM pk w JOIN po o ON o.device_id = w.device_id AND o.rn = w.rn + 1)"""


@query("pack_windows", f"""
WITH RECURSIVE {QUERIES_SQL_PACK}
SELECT device_id, id, window_id, ord, offset_ms FROM pk""")
def pack_windows(spark, d):
    return L.pack_windows(_dense(spark, d)).select("device_id", "id", "window_id", "ord", "offset_ms")


@query("reprocess_extent", f"""
WITH e AS (SELECT device_id, run_id, epoch, min(n_start) AS a, max(n_start + n_samples) AS b FROM v_raw
  WHERE start_utc_ms >= {BASE + 5 * 86_400_000} AND start_utc_ms < {BASE + 9 * 86_400_000} AND device_id = 'u7' GROUP BY ALL)
SELECT e.device_id, e.epoch, least(a, coalesce(min(c.n_start), a)) AS n_lo, greatest(b, coalesce(max(c.n_start + c.n_samples), b)) AS n_hi, TRUE AS is_tail
FROM e LEFT JOIN v_chunks c ON c.device_id = e.device_id AND c.run_id = e.run_id AND c.epoch = e.epoch AND c.kind = 'derived'
  AND c.n_start < b AND c.n_start + c.n_samples > a GROUP BY e.device_id, e.epoch, a, b""")
def reprocess_extent(spark, d):
    return A.reprocess_extent(V.raw_segments(spark, d), V.chunks(spark, d).where("kind = 'derived'"), None, "u7",
                              BASE + 5 * 86_400_000, BASE + 9 * 86_400_000).select("device_id", "epoch", "n_lo", "n_hi", "is_tail")


@query("segment_grid", """
WITH e AS (SELECT run_id, epoch, min(n_start) AS a, max(n_start + n_samples) AS b FROM v_raw GROUP BY ALL)
SELECT run_id, epoch, a + k * 57600000 AS n_start, least(57600000, b - a - k * 57600000) AS n_samples,
  CASE WHEN b - a - k * 57600000 >= 57600000 THEN 'cap' ELSE 'shutdown' END AS cut_reason, epoch > 0 AND k = 0 AS discontinuity
FROM e, LATERAL (SELECT unnest(range(0, (b - a + 57599999) // 57600000)) AS k)""")
def segment_grid(spark, d):
    raw = V.raw_segments(spark, d)
    epochs = raw.groupBy("run_id", "epoch").agg(F.min("n_start").alias("n_start"),
                                                F.max(F.col("n_start") + F.col("n_samples")).alias("n_end"))
    return A.segment_grid(epochs.withColumn("ends", F.lit("shutdown")), 57_600_000)


@query("zero_runs", """
SELECT device_id, min(n_start) AS run_start, CAST(sum(n_frames) AS BIGINT) AS zero_samples FROM (
  SELECT *, sum(f) OVER (PARTITION BY device_id ORDER BY n_start ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN z = lag(z) OVER (PARTITION BY device_id ORDER BY n_start) THEN 0 ELSE 1 END AS f FROM (
      SELECT device_id, n_start, n_samples AS n_frames, event_type IN ('view', 'click') AS z FROM v_events e
      JOIN v_chunks c ON c.id = e.event_id AND c.n_samples > 0 AND c.device_id = e.device_id))) WHERE z GROUP BY device_id, g
HAVING sum(n_frames) >= 60 * 60 * 16000""".replace("SELECT device_id, n_start, n_samples AS n_frames", "SELECT c.device_id, n_start, n_samples AS n_frames"))
def zero_runs(spark, d):
    e = V._events(spark, d).select(
        "device_id", ((F.col("start_utc_ms") - BASE) * 16).alias("n_start"), (F.col("duration_ms") * 16).alias("n_frames"),
        F.col("event_type").isin("view", "click").alias("is_zero"))
    return A.zero_runs(e, ["device_id"], 3600.0)


# ------------------------------------------------------------- calendar and timeline


def _edges_sql(lo: int, hi: int, tz: str, unit: str) -> str:
    local = f"timezone('{tz}', make_timestamptz(g * 1000))"
    before = f"timezone('{tz}', make_timestamptz((g - 900000) * 1000))"
    rule = (f"date_trunc('hour', {local}) = {local}" if unit == "hour" else
            f"(CAST({local} AS TIME) = TIME '00:00:00' OR CAST({local} AS DATE) > CAST({before} AS DATE))")
    return f"""SELECT DISTINCT edge_ms FROM (SELECT g AS edge_ms FROM range(({lo} + 899999) // 900000 * 900000, {hi}, 900000) t(g)
  WHERE g > {lo} AND {rule} UNION ALL SELECT {lo} UNION ALL SELECT {hi})"""


def _buckets_sql(lo: int, hi: int, tz: str, unit: str) -> str:
    return f"""SELECT * FROM (SELECT edge_ms AS from_ms, lead(edge_ms) OVER (ORDER BY edge_ms) AS to_ms FROM
  ({_edges_sql(lo, hi, tz, unit)})) WHERE to_ms IS NOT NULL"""


@query("calendar_days_gap_zone", "SELECT from_ms, to_ms, (SELECT count(*) FROM events WHERE epoch_us(ts) // 1000 >= 0) AS n_events FROM ("
       + _buckets_sql(1_540_000_000_000, 1_543_000_000_000, "America/Sao_Paulo", "day") + ")")
def calendar_days_gap_zone(spark, d):
    grid = TL.buckets_of(TL.calendar_edges(spark, 1_540_000_000_000, 1_543_000_000_000, "America/Sao_Paulo", "day"))
    n = V.table(spark, d, "events").agg(F.count("*")).scalar()
    return grid.select(F.col("bucket_from").alias("from_ms"), F.col("bucket_to").alias("to_ms"), n.alias("n_events"))


@query("source_extents", """
SELECT device_id, min(a) AS first_known_ms, max(b) AS last_known_ms FROM (
  SELECT device_id, start_utc_ms AS a, end_utc_ms AS b FROM v_chunks
  UNION ALL SELECT device_id, start_utc_ms, start_utc_ms + n_samples * 1000 // 16000 FROM v_raw
  UNION ALL SELECT device_id, start_utc_ms, end_utc_ms FROM v_spans) GROUP BY device_id""")
def source_extents(spark, d):
    return TL.source_extents(V.chunks(spark, d), V.raw_segments(spark, d), V.dictation_spans(spark, d))


def _timeline_sql(lo: int, hi: int, tz: str, unit: str) -> str:
    def cover(table: str, alias: str) -> str:
        clipped = f"(SELECT DISTINCT p.device_id, b.from_ms, b.to_ms, greatest(p.a, b.from_ms) AS a, least(p.b, b.to_ms) AS b FROM ({table}) p JOIN bk b ON p.a < b.to_ms AND p.b > b.from_ms AND p.b > p.a)"
        return f"""{alias} AS (SELECT device_id, from_ms, CAST(sum(y - x) AS BIGINT) AS ms FROM (
          SELECT device_id, from_ms, min(a) AS x, max(b) AS y FROM (SELECT *, sum(f) OVER (PARTITION BY device_id, from_ms ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM (
            SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY device_id, from_ms ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f
            FROM {clipped})) GROUP BY device_id, from_ms, g) GROUP BY device_id, from_ms)"""

    evidence = """SELECT device_id, start_utc_ms AS a, end_utc_ms AS b, status, kind FROM v_chunks
      UNION ALL SELECT device_id, start_utc_ms, start_utc_ms + n_samples * 1000 // 16000, status, 'raw' FROM v_raw"""
    parts = [
        f"bk AS MATERIALIZED ({_buckets_sql(lo, hi, tz, unit)})", f"ev AS MATERIALIZED ({evidence})",
        cover("SELECT device_id, start_utc_ms AS a, end_utc_ms AS b FROM v_stt", "t"),
        cover("SELECT * FROM ev", "c"), cover("SELECT * FROM ev WHERE status = 'pending'", "p"),
        cover("SELECT * FROM ev WHERE status = 'failed'", "f"),
        cover("SELECT * FROM ev WHERE kind = 'raw' AND status = 'segmented'", "s"),
        # segmented minus derived = (segmented or derived) minus derived, by inclusion of lengths
        cover("SELECT * FROM ev WHERE (kind = 'raw' AND status = 'segmented') OR kind = 'derived'", "sd"),
        cover("SELECT * FROM ev WHERE kind = 'derived'", "dv"),
        """n AS (SELECT device_id, from_ms, count(*) AS n FROM v_stt JOIN bk ON start_utc_ms < to_ms AND (end_utc_ms > from_ms
          OR (end_utc_ms = start_utc_ms AND start_utc_ms >= from_ms)) GROUP BY ALL)""",
        "src AS (SELECT DISTINCT device_id FROM v_events)",
    ]
    return "WITH " + ",\n".join(parts) + """
SELECT src.device_id, bk.from_ms, bk.to_ms, coalesce(t.ms, 0) AS text_ms, coalesce(n.n, 0) AS n_segments, coalesce(c.ms, 0) AS captured_ms,
  coalesce(p.ms, 0) AS pending_ms, coalesce(f.ms, 0) AS failed_ms, coalesce(sd.ms, 0) - coalesce(dv.ms, 0) AS no_detected_speech_ms,
  bk.to_ms - bk.from_ms - coalesce(c.ms, 0) AS unknown_ms
FROM src CROSS JOIN bk LEFT JOIN t USING (device_id, from_ms) LEFT JOIN n USING (device_id, from_ms) LEFT JOIN c USING (device_id, from_ms)
LEFT JOIN p USING (device_id, from_ms) LEFT JOIN f USING (device_id, from_ms) LEFT JOIN sd USING (device_id, from_ms) LEFT JOIN dv USING (device_id, from_ms)"""


def _timeline(spark, d, unit):
    return TL.timeline(spark, V.stt_rows(spark, d), V.chunks(spark, d), V.raw_segments(spark, d),
                       V.dictation_spans(spark, d), BASE, AS_OF, "Europe/Oslo", unit)


@query("timeline_hour", _timeline_sql(BASE, AS_OF, "Europe/Oslo", "hour"))
def timeline_hour(spark, d):
    return _timeline(spark, d, "hour")


@query("timeline_day_oslo", _timeline_sql(BASE, AS_OF, "Europe/Oslo", "day"))
def timeline_day_oslo(spark, d):
    return _timeline(spark, d, "day")


@query("evidence_daily", f"""
SELECT device_id, local_date, CAST(sum(n_segments) AS BIGINT) AS n_segments, CAST(sum(captured_ms) AS BIGINT) AS captured_ms,
  CAST(sum(pending_ms) AS BIGINT) AS pending_ms, CAST(sum(failed_ms) AS BIGINT) AS failed_ms,
  CAST(sum(no_detected_speech_ms) AS BIGINT) AS no_detected_speech_ms, CAST(sum(unknown_ms) AS BIGINT) AS unknown_ms
FROM (SELECT *, strftime(timezone('Europe/Oslo', make_timestamptz(from_ms * 1000)), '%Y-%m-%d') AS local_date FROM ({_timeline_sql(BASE, AS_OF, "Europe/Oslo", "hour")}))
GROUP BY ALL""".replace("SELECT device_id, local_date", "SELECT device_id, local_date"))
def evidence_daily(spark, d):
    out = TL.daily_evidence(_timeline(spark, d, "hour"), "Europe/Oslo")
    return out.withColumn("local_date", F.date_format("local_date", "yyyy-MM-dd"))


@query("local_days", """
SELECT event_id, strftime(l, '%Y-%m-%d') AS local_date, epoch_ms(timezone('Europe/Oslo', date_trunc('day', l))) AS midnight_ms,
  strftime(date_trunc('week', l), '%Y-%m-%d') AS week_start
FROM (SELECT event_id, timezone('Europe/Oslo', make_timestamptz(start_utc_ms * 1000)) AS l FROM v_events)""")
def local_days(spark, d):
    day = T.local_date("start_utc_ms", "Europe/Oslo")
    return V._events(spark, d).select(
        "event_id", F.date_format(day, "yyyy-MM-dd").alias("local_date"), T.local_midnight_ms(day, "Europe/Oslo").alias("midnight_ms"),
        F.date_format(T.week_start(day), "yyyy-MM-dd").alias("week_start"))


@query("time_forms", f"""
SELECT event_id, {iso('start_utc_ms')} AS iso, {compact('start_utc_ms')} AS compact, strftime(make_timestamp(start_utc_ms * 1000), '%H:%M:%S') AS hms,
  start_utc_ms AS back_ms, start_utc_ms // 1000 * 1000 AS user_ms, {iso('(start_utc_ms * 1000000 + event_id % 1000000 + 500000) // 1000000')} AS ns_iso,
  (event_id * 1000 + 8000) // 16000 AS half_up_ms, event_id * 1000 // 16000 AS floor_ms FROM v_events""")
def time_forms(spark, d):
    e = V._events(spark, d)
    seconds = F.date_format(F.timestamp_millis("start_utc_ms"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return e.select(
        "event_id", T.ms_to_iso("start_utc_ms").alias("iso"), T.ms_to_compact("start_utc_ms").alias("compact"),
        T.ms_to_hms("start_utc_ms").alias("hms"), T.iso_to_ms(T.ms_to_iso("start_utc_ms")).alias("back_ms"),
        T.user_time_ms(seconds).alias("user_ms"),
        T.ns_to_iso(F.col("start_utc_ms") * 1_000_000 + F.col("event_id") % 1_000_000).alias("ns_iso"),
        T.samples_to_ms("event_id").alias("half_up_ms"), T.samples_to_ms_floor("event_id").alias("floor_ms"))


# ------------------------------------------------------------- reports


_DEVICES = f"""
SELECT device_id, n_chunks, n_pending, n_failed, n_derived, coalesce(n_raw, 0) AS n_raw, coalesce(n_raw_pending, 0) AS n_raw_pending,
  n_sessions, {iso('a')} AS first_chunk_utc, {iso('b')} AS last_chunk_utc, {iso('r')} AS last_received_utc, {iso('lr')} AS last_raw_utc
FROM (SELECT device_id, count(*) AS n_chunks, count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'failed') AS n_failed,
    count(*) FILTER (kind = 'derived') AS n_derived, min(start_utc_ms) AS a, max(start_utc_ms) AS b, max(received_utc_ms) AS r FROM v_chunks GROUP BY ALL)
LEFT JOIN (SELECT device_id, count(*) AS n_raw, count(*) FILTER (status = 'pending') AS n_raw_pending, max(start_utc_ms) AS lr FROM v_raw GROUP BY ALL) USING (device_id)
LEFT JOIN (SELECT device_id, count(*) AS n_sessions FROM v_sessions GROUP BY ALL) USING (device_id)"""


@query("device_summary", _DEVICES)
def device_summary(spark, d):
    return R.device_summary(V.chunks(spark, d), V.raw_segments(spark, d), _sessions(spark, d))


@query("status_counts", """
SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'lost') AS lost FROM v_chunks""")
def status_counts(spark, d):
    return R.status_counts(V.chunks(spark, d), (*R.CHUNK_STATUSES, "lost"))


_STATUS = f"""
SELECT {iso(str(AS_OF))} AS now_utc, (SELECT count(*) FROM v_chunks WHERE status = 'pending') AS chunks_pending,
  (SELECT count(*) FROM v_chunks WHERE status = 'done') AS chunks_done, (SELECT count(*) FROM v_chunks WHERE status = 'failed') AS chunks_failed,
  (SELECT count(*) FROM v_chunks WHERE kind = 'derived') AS derived_chunks,
  (SELECT round(({AS_OF} - min(received_utc_ms)) / 1000.0, 1) FROM v_chunks WHERE status = 'pending') AS pending_oldest_age_s,
  (SELECT {iso('max(transcribed_utc_ms)')} FROM v_chunks) AS last_transcribed_utc,
  (SELECT count(*) FROM v_raw WHERE status = 'pending') AS raw_pending, (SELECT count(*) FROM v_raw WHERE status = 'segmented') AS raw_segmented,
  (SELECT count(*) FROM v_raw WHERE status = 'failed') AS raw_failed,
  (SELECT round(({AS_OF} - min(received_utc_ms)) / 1000.0, 1) FROM v_raw WHERE status = 'pending') AS raw_pending_oldest_age_s,
  (SELECT count(*) FROM v_segments) AS segments, (SELECT count(superseded_by) FROM v_segments) AS superseded_segments,
  (SELECT count(*) FROM v_spans WHERE status = 'pending') AS spans_pending, (SELECT count(*) FROM v_spans WHERE status = 'applied') AS spans_applied,
  (SELECT count(*) FROM v_sessions) AS sessions, (SELECT count(*) FROM v_sessions WHERE {AS_OF} - end_utc_ms <= 14400000) AS open_sessions"""


def _status(spark, d):
    return R.status_frame(V.chunks(spark, d), V.raw_segments(spark, d), V.segments(spark, d), V.dictation_spans(spark, d),
                          _sessions(spark, d), AS_OF)


@query("status_frame", _STATUS)
def status_frame(spark, d):
    return _status(spark, d)


@query("status_metrics", f"""
WITH s AS ({_STATUS}), dv AS ({_DEVICES})
SELECT m AS metric, l AS labels, CAST(v AS DOUBLE) AS value FROM (
  SELECT unnest([{{'m': 'chunks_total', 'l': '{{status="pending"}}', 'v': chunks_pending::DOUBLE}}, {{'m': 'chunks_total', 'l': '{{status="done"}}', 'v': chunks_done}},
    {{'m': 'chunks_total', 'l': '{{status="failed"}}', 'v': chunks_failed}}, {{'m': 'raw_segments_total', 'l': '{{status="pending"}}', 'v': raw_pending}},
    {{'m': 'raw_segments_total', 'l': '{{status="segmented"}}', 'v': raw_segmented}}, {{'m': 'raw_segments_total', 'l': '{{status="failed"}}', 'v': raw_failed}},
    {{'m': 'dictation_spans_total', 'l': '{{status="pending"}}', 'v': spans_pending}}, {{'m': 'dictation_spans_total', 'l': '{{status="applied"}}', 'v': spans_applied}},
    {{'m': 'segments', 'l': '', 'v': segments}}, {{'m': 'superseded_segments', 'l': '', 'v': superseded_segments}}, {{'m': 'sessions', 'l': '', 'v': sessions}},
    {{'m': 'open_sessions', 'l': '', 'v': open_sessions}}, {{'m': 'pending_oldest_age_s', 'l': '', 'v': pending_oldest_age_s}},
    {{'m': 'raw_pending_oldest_age_s', 'l': '', 'v': raw_pending_oldest_age_s}}], recursive := true) FROM s
  UNION ALL SELECT '{{device_id="' || device_id || '"}}', 'device_chunks_pending', n_pending FROM dv WHERE FALSE
  UNION ALL SELECT 'device_chunks_pending', '{{device_id="' || device_id || '"}}', n_pending FROM dv
  UNION ALL SELECT 'device_raw_pending', '{{device_id="' || device_id || '"}}', n_raw_pending FROM dv)""")
def status_metrics(spark, d):
    devices = R.device_summary(V.chunks(spark, d), V.raw_segments(spark, d), _sessions(spark, d))
    out = R.metric_lines(_status(spark, d), devices)
    return out.select(F.regexp_replace("metric", "^speechlog_", "").alias("metric"), "labels", "value")


@query("health_eval", """
WITH h AS (SELECT device_id, max(start_utc_ms) FILTER (event_type = 'view' AND user_id % 4 <> 1) AS cap, count(*) FILTER (event_type = 'view' AND user_id % 4 <> 2) > 0 AS present, bool_or(event_type = 'signup' AND value > 100) AS stopped,
    max(value) AS frame_age, count(*) % 7 <> 0 AS disk_ok, min(start_utc_ms) FILTER (event_type = 'error') AS oldest,
    max(start_utc_ms) FILTER (event_type = 'purchase') AS ok, max(start_utc_ms) FILTER (event_type = 'click') AS up,
    CASE WHEN count(*) % 5 = 0 THEN '401 denied' WHEN count(*) % 5 = 1 THEN '500 oops' END AS err FROM v_events GROUP BY device_id),
a AS (SELECT *, (1706600000000 - CASE WHEN present THEN cap END) / 1000.0 AS cap_age, (1706600000000 - oldest) / 1000.0 AS pend_age, (1706600000000 - ok) / 1000.0 AS ok_age,
    (1706600000000 - up) / 1000.0 AS up_age FROM h)
SELECT device_id, array_to_string(list_filter([
  CASE WHEN NOT present THEN 'no capture status' WHEN stopped THEN 'capture has stopped' WHEN cap IS NULL THEN 'capture status without a time' WHEN greatest(cap_age, 0) > 120 THEN 'capture status is old: ' || CAST(round_even(greatest(cap_age, 0), 0) AS BIGINT) || ' s' END,
  CASE WHEN frame_age + greatest(cap_age, 0) > 60 THEN 'no frame for ' || CAST(round_even(frame_age + greatest(cap_age, 0), 0) AS BIGINT) || ' s' END,
  CASE WHEN NOT disk_ok THEN 'no room for audio' END,
  CASE WHEN greatest(pend_age, 0) > 3600 AND (ok IS NULL OR greatest(ok_age, 0) > 3600) THEN 'nothing uploaded, files wait for ' || CAST(round_even(greatest(pend_age, 0), 0) AS BIGINT) || ' s' END,
  CASE WHEN up IS NULL OR greatest(up_age, 0) > 960 THEN 'uploader silent' END,
  CASE WHEN err LIKE '401%' OR err LIKE '403%' THEN 'upload refused: ' || err END], lambda x: x IS NOT NULL), '|') AS reasons FROM a""")
def health_eval(spark, d):
    def stamp(kind, fn):
        return fn(F.when(F.col("event_type") == kind, F.col("start_utc_ms"))) * 1_000_000
    e = V._events(spark, d)
    n = F.count("*")
    state = e.groupBy("device_id").agg(
        F.max(F.when((F.col("event_type") == "view") & (F.col("user_id") % 4 != 1), F.col("start_utc_ms"))).alias("_cap"),
        (F.count(F.when((F.col("event_type") == "view") & (F.col("user_id") % 4 != 2), 1)) > 0).alias("capture_present"),
        F.bool_or((F.col("event_type") == "signup") & (F.col("value") > 100)).alias("capture_stopped"),
        F.max("value").alias("last_frame_age_s"), (n % 7 != 0).alias("disk_ok"), stamp("error", F.min).alias("oldest_pending_ns"),
        stamp("purchase", F.max).alias("last_success_ns"), stamp("click", F.max).alias("uploader_written_ns"),
        F.when(n % 5 == 0, "401 denied").when(n % 5 == 1, "500 oops").alias("last_error"))
    state = state.withColumn("capture_written_ns", F.when(F.col("capture_present"), F.col("_cap") * 1_000_000))
    out = R.health(state, 1_706_600_000_000_000_000)
    return out.select("device_id", F.array_join("reasons", "|").alias("reasons"))


@query("claim_queue", f"""
SELECT id, device_id, start_utc_ms FROM v_chunks WHERE status = 'pending' AND attempts < 3 AND end_utc_ms <= {AS_OF - 86_400_000 - 20_000}
ORDER BY device_id, start_utc_ms, id LIMIT 50""")
def claim_queue(spark, d):
    return P.claim_queue(V.chunks(spark, d), AS_OF - 86_400_000).select("id", "device_id", "start_utc_ms")


@query("eligible_chunks", f"""
SELECT id FROM v_chunks WHERE status = 'pending' AND attempts < 3 AND end_utc_ms <= {AS_OF - 20_000}""")
def eligible_chunks(spark, d):
    return P.claim_queue(V.chunks(spark, d), AS_OF, batch=None).select("id")
