"""The views of `views.py` in DuckDB SQL, for the checks."""

BASE_MS = 1_704_067_200_000

_PATH = "strftime(make_timestamp(start_utc_ms*1000), '%Y/%m/%d') || '/' || strftime(make_timestamp(start_utc_ms*1000), '%Y%m%dT%H%M%S%g') || 'Z_'"


def iso(ms: str) -> str:
    return f"strftime(make_timestamp(({ms})*1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def compact(ms: str) -> str:
    return f"strftime(make_timestamp(({ms})*1000), '%Y%m%dT%H%M%S%g') || 'Z'"


VIEWS = {
    "v_events": """
SELECT event_id, user_id, event_type, value, props, 'u' || user_id AS device_id, 'r' || user_id AS run_id,
  user_id % 3 AS epoch, epoch_us(ts) // 1000 AS start_utc_ms, CAST(round(value * 60000) AS BIGINT) AS duration_ms,
  epoch_us(ts) // 1000 + CAST(round(value * 60000) AS BIGINT) AS end_utc_ms FROM events""",
    "v_chunks": f"""
SELECT event_id AS id, sha256('e' || event_id) AS sha256, CASE WHEN event_type = 'view' THEN 'derived' ELSE 'speech' END AS kind,
  device_id, start_utc_ms, end_utc_ms, duration_ms,
  CASE WHEN event_id % 5 <> 0 THEN {_PATH} || substr(sha256('e' || event_id), 1, 8) || '.opus' END AS path,
  run_id, epoch, (start_utc_ms - {BASE_MS}) * 16 AS n_start, duration_ms * 16 AS n_samples,
  end_utc_ms + 1000 * (event_id % 7) AS received_utc_ms,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'done' END AS status,
  event_id % 4 AS attempts,
  CASE WHEN event_type NOT IN ('error', 'signup') THEN end_utc_ms + 1000 * (event_id % 7) + 5000 END AS transcribed_utc_ms,
  'm' || (event_id % 2) AS model_id, CASE WHEN event_id % 5 <> 0 THEN 'r1' END AS model_revision FROM v_events""",
    "v_raw": f"""
SELECT event_id AS id, sha256('w' || event_id) AS sha256, device_id, run_id, epoch, (start_utc_ms - {BASE_MS}) * 16 AS n_start,
  duration_ms * 16 AS n_samples, start_utc_ms, end_utc_ms + 1000 AS received_utc_ms,
  CASE event_type WHEN 'view' THEN 'segmented' ELSE 'pending' END AS status
FROM v_events WHERE event_type IN ('view', 'error')""",
    "v_coverage": """
WITH RECURSIVE c AS (SELECT id, device_id, run_id, epoch, n_start, n_start + n_samples AS n_end FROM v_chunks WHERE kind = 'derived'),
p AS (SELECT c.id, c.n_start, c.n_end, r.n_start AS a, r.n_start + r.n_samples AS b, row_number() OVER (PARTITION BY c.id ORDER BY r.n_start, r.id) AS rn
  FROM c JOIN v_raw r ON r.device_id = c.device_id AND r.run_id = c.run_id AND r.epoch = c.epoch
    AND r.n_start < c.n_end AND r.n_start + r.n_samples > c.n_start AND r.status <> 'failed'),
w AS (SELECT id, rn, b AS reach, CASE WHEN a <= n_start THEN b ELSE n_start END AS pos FROM p WHERE rn = 1
  UNION ALL SELECT p.id, p.rn, CASE WHEN p.a < w.reach THEN w.reach ELSE p.b END, CASE WHEN p.a >= w.reach AND p.a <= w.pos AND p.b > w.pos THEN p.b ELSE w.pos END
  FROM w JOIN p ON p.id = w.id AND p.rn = w.rn + 1),
covered AS (SELECT c.id, coalesce(max(w.pos), c.n_start) >= c.n_end AND count(w.id) > 0 AS is_covered FROM c LEFT JOIN w ON w.id = c.id GROUP BY c.id, c.n_start, c.n_end)
SELECT * FROM covered""",
    "v_spans": """
SELECT event_id AS id, device_id, start_utc_ms, end_utc_ms, 'span ' || event_id AS text,
  CASE WHEN event_id % 3 = 0 THEN 'no' ELSE 'en' END AS lang, 'engine-a' AS engine,
  CASE WHEN event_id % 2 = 0 THEN 'raw' ELSE 'cleanup' END AS mode,
  CASE WHEN event_id % 4 = 0 THEN '' END AS app, CAST(NULL AS VARCHAR) AS "window", event_id % 5 = 0 AS cancelled,
  'tool' AS origin, props->>'$.k' AS k, end_utc_ms + 2000 AS received_utc_ms,
  CASE WHEN event_id % 7 = 0 THEN 'pending' ELSE 'applied' END AS status
FROM v_events WHERE event_type = 'purchase'""",
    "v_spans_n": f"SELECT device_id, (start_utc_ms - {BASE_MS}) * 16 AS n_start FROM v_spans",
    "v_stt": """
SELECT event_id AS id, event_id AS chunk_id, device_id, start_utc_ms, end_utc_ms,
  event_type || ' ' || user_id || ' row ' || event_id AS text FROM v_events WHERE event_type <> 'purchase'""",
    "v_tags": """
SELECT event_id AS id, event_id % 997 AS segment_id, 'channel' AS key,
  CASE WHEN event_id % 4 = 0 THEN 'dictation' ELSE 'ambient' END AS value,
  CASE WHEN event_id % 3 = 0 THEN 'deterministic' ELSE 'model' END AS source, 'tool' AS origin FROM v_events
UNION ALL
SELECT event_id + 1000000000000, event_id % 997, 'app', 'k' || (props->>'$.k'),
  CASE WHEN event_id % 3 = 0 THEN 'deterministic' ELSE 'model' END, 'tool' FROM v_events""",
    "v_span_tags": """
SELECT event_id AS id, device_id, start_utc_ms, CASE WHEN event_type = 'click' THEN start_utc_ms ELSE end_utc_ms END AS end_utc_ms,
  CASE WHEN event_id % 2 = 0 THEN 'app' ELSE 'mode' END AS key, 'v' || (event_id % 10) AS value,
  CASE WHEN event_id % 3 = 0 THEN 'model' ELSE 'deterministic' END AS source
FROM v_events WHERE event_type IN ('view', 'click', 'purchase')""",
    "v_segments": f"""
SELECT conv_id * 8 + turn AS id,
  CASE WHEN (conv_id * 8 + turn) % 11 <> 5 THEN conv_id * 8 + (turn - turn % 2) END AS chunk_id,
  'u' || (conv_id % 20) AS device_id,
  CASE WHEN (conv_id * 8 + turn) % 11 = 0 THEN conv_id * 8 + turn END AS span_id,
  CASE WHEN (conv_id * 8 + turn) % 13 = 0 THEN conv_id END AS superseded_by, turn % 2 AS idx,
  {BASE_MS} + conv_id * 600000 + turn * 20000 AS start_utc_ms,
  {BASE_MS} + conv_id * 600000 + turn * 20000 + CASE WHEN turn = 7 THEN 0 ELSE least(15000, length(text) * 50) END AS end_utc_ms,
  text, CASE WHEN conv_id % 3 = 0 THEN 'no' ELSE 'en' END AS lang, 'm' || (conv_id % 2) AS model_id,
  CASE WHEN conv_id % 4 <> 0 THEN 'r' || (turn % 4) END AS model_revision, role, conv_id, turn FROM conversations""",
    "v_seg_chunks": f"""
SELECT conv_id * 8 + turn AS id, 'u' || (conv_id % 20) AS device_id,
  {BASE_MS} + conv_id * 600000 + turn * 20000 AS start_utc_ms, {BASE_MS} + conv_id * 600000 + turn * 20000 + 39000 AS end_utc_ms,
  'm' || (conv_id % 2) AS model_id, CASE WHEN conv_id % 4 <> 0 THEN 'r' || (turn % 4) END AS model_revision,
  CASE WHEN conv_id % 9 = 0 THEN 'pending' ELSE 'done' END AS status,
  CASE WHEN conv_id % 5 <> 0 THEN 'a/' || (conv_id * 8 + turn) || '.opus' END AS path
FROM conversations WHERE turn % 2 = 0""",
    "v_corpus": f"""
SELECT doc_id AS id, text, lang, 'u' || (doc_id % 20) AS device_id, {BASE_MS} + doc_id * 1000 AS start_utc_ms,
  {BASE_MS} + doc_id * 1000 + (doc_id % 4) * 500 AS end_utc_ms, CASE WHEN doc_id % 17 = 0 THEN 1 END AS superseded_by FROM documents""",
    "v_mapped": """
SELECT d.doc_id AS id, d.doc_id % 50 AS chunk_id, d.text, l.quality - 1.5 AS avg_logprob, l.toxic * 0.9 AS no_speech_prob,
  CASE WHEN d.doc_id % 10 = 0 THEN 2.5 WHEN d.doc_id % 10 < 5 THEN 1.2 END AS compression_ratio
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "v_dense": f"""
SELECT id, sha256, kind, device_id, {BASE_MS} + (start_utc_ms - {BASE_MS}) // 1000 AS start_utc_ms,
  {BASE_MS} + (start_utc_ms - {BASE_MS}) // 1000 + duration_ms // 1000 AS end_utc_ms, duration_ms // 1000 AS duration_ms
FROM v_chunks""",
    # Effective channel per transcript row.
    "v_channel": """
SELECT segment_id, value FROM (SELECT *, row_number() OVER (PARTITION BY segment_id
  ORDER BY (source = 'deterministic') DESC, id DESC) AS rn FROM v_tags WHERE key = 'channel') WHERE rn = 1""",
    "v_visible": """
SELECT s.*, coalesce(ch.value, 'ambient') AS channel FROM v_segments s LEFT JOIN v_channel ch ON ch.segment_id = s.id
WHERE s.superseded_by IS NULL""",
    # Visible rows of the chunk's current producer, ambient channel.
    "v_current": """
SELECT v.* FROM v_visible v LEFT JOIN v_seg_chunks c ON c.id = v.chunk_id
WHERE v.channel <> 'dictation' AND (v.span_id IS NOT NULL
  OR (v.model_id = c.model_id AND v.model_revision IS NOT DISTINCT FROM c.model_revision))""",
    "v_sessions": f"""
SELECT device_id || '_' || {compact('min(start_utc_ms)')} AS session_id, device_id, min(start_utc_ms) AS start_utc_ms,
  max(end_utc_ms) AS end_utc_ms, count(*) AS n_chunks FROM (
    SELECT *, sum(f) OVER (PARTITION BY device_id ORDER BY start_utc_ms, id ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN start_utc_ms - lag(end_utc_ms) OVER (PARTITION BY device_id ORDER BY start_utc_ms, id) <= 14400000
        THEN 0 ELSE 1 END AS f FROM v_chunks)) GROUP BY device_id, g""",
    "v_seg_sessions": f"""
SELECT id, device_id || '_' || {compact('min(start_utc_ms) OVER (PARTITION BY device_id, g)')} AS session_id,
  device_id, start_utc_ms, end_utc_ms, min(start_utc_ms) OVER (PARTITION BY device_id, g) AS session_start,
  max(end_utc_ms) OVER (PARTITION BY device_id, g) AS session_end FROM (
    SELECT *, sum(f) OVER (PARTITION BY device_id ORDER BY start_utc_ms, id ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN start_utc_ms - lag(end_utc_ms) OVER (PARTITION BY device_id ORDER BY start_utc_ms, id) <= 300000
        THEN 0 ELSE 1 END AS f FROM v_seg_chunks))""",
}
