"""Queries: tags, visibility, read routes, search, reconciliation, word mapping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import times as T
from ..functions.checks import with_target_facts
from ..operators import folds as L
from ..operators import intervals as I
from ..operators import paging as P
from ..operators import reconcile as RC
from ..operators import reports as R
from ..operators import search as Q
from ..operators import sessions as S
from ..operators import tags as G
from ..operators import transcripts as TR
from ..operators import visibility as VS
from ..session import materialise
from ..sources import stt
from . import surface as U
from . import views as V
from .catalog_timeline import QUERIES_SQL_PACK, _dense as dense
from .check_views import iso
from .registry import query

BASE, AS_OF = V.BASE_MS, V.AS_OF_MS
HOUR = 3_600_000


def _seg(spark, d):
    return V.segments(spark, d), V.segment_chunks(spark, d), V.tags(spark, d)


# ------------------------------------------------------------- tags and visibility


@query("effective_channel", "SELECT id, channel FROM v_visible UNION ALL SELECT s.id, coalesce(c.value, 'ambient') FROM v_segments s "
       "LEFT JOIN v_channel c ON c.segment_id = s.id WHERE s.superseded_by IS NOT NULL")
def effective_channel(spark, d):
    s, _, t = _seg(spark, d)
    return G.with_channel(s, t).select("id", "channel")


@query("effective_tags", """
SELECT segment_id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, key ORDER BY (source = 'deterministic') DESC, id DESC) AS rn
  FROM v_tags) WHERE rn = 1""")
def effective_tags(spark, d):
    return G.effective_tags(V.tags(spark, d))


@query("tag_list", """
SELECT segment_id, id, key, value, row_number() OVER (PARTITION BY segment_id, key ORDER BY (source = 'deterministic') DESC, id DESC) = 1 AS effective FROM v_tags""")
def tag_list(spark, d):
    return G.tag_flags(V.tags(spark, d)).select("segment_id", "id", "key", "value", "effective")


@query("tag_list_nested", """
SELECT segment_id, string_agg(key || '=' || value || ':' || source || CASE WHEN e THEN '*' ELSE '' END, ',' ORDER BY (source = 'deterministic') DESC, id DESC) AS tags
FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, key ORDER BY (source = 'deterministic') DESC, id DESC) = 1 AS e FROM v_tags) GROUP BY segment_id""")
def tag_list_nested(spark, d):
    one = F.transform("tags", lambda t: F.concat(t["key"], F.lit("="), t["value"], F.lit(":"), t["source"],
                                                 F.when(t["effective"], "*").otherwise("")))
    return G.tag_lists(V.tags(spark, d)).select("segment_id", F.array_join(one, ",").alias("tags"))


@query("visible_rows", "SELECT id, channel FROM v_visible WHERE channel <> 'dictation'")
def visible_rows(spark, d):
    s, _, t = _seg(spark, d)
    return VS.default_rows(s, t).select("id", "channel")


@query("transcript_window", f"""
SELECT id, device_id, start_utc_ms, end_utc_ms, channel FROM v_visible v WHERE start_utc_ms < {BASE + 40 * HOUR} AND (end_utc_ms > {BASE + HOUR}
  OR (end_utc_ms = start_utc_ms AND start_utc_ms >= {BASE + HOUR})) AND (span_id IS NOT NULL OR EXISTS (SELECT 1 FROM v_seg_chunks c
  WHERE c.id = v.chunk_id AND c.model_id = v.model_id AND c.model_revision IS NOT DISTINCT FROM v.model_revision))""")
def transcript_window(spark, d):
    s, c, t = _seg(spark, d)
    return U.transcript_all(s, c, t, BASE + HOUR, BASE + 40 * HOUR, channel="all").select(
        "id", "device_id", "start_utc_ms", "end_utc_ms", "channel")


@query("transcript_current", "SELECT id, channel, lang FROM v_current")
def transcript_current(spark, d):
    s, c, t = _seg(spark, d)
    return VS.policy_rows(s, c, t).select("id", "channel", "lang")


@query("transcript_recipient", """
SELECT v.id FROM v_current v JOIN (SELECT segment_id, value FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY
  (source = 'deterministic') DESC, id DESC) AS rn FROM v_tags WHERE key = 'app') WHERE rn = 1) a ON a.segment_id = v.id AND a.value IN ('k7') AND v.lang = 'en'""")
def transcript_recipient(spark, d):
    s, c, t = _seg(spark, d)
    return VS.policy_rows(s, c, t, lang="en", recipients={"app": "k7"}).select("id")


@query("keyset_page", f"""
SELECT id, device_id, start_utc_ms FROM v_current WHERE (start_utc_ms, device_id, id) > ({BASE + 2 * HOUR}, 'u12', 100)
ORDER BY start_utc_ms, device_id, id LIMIT 41""")
def keyset_page(spark, d):
    s, c, t = _seg(spark, d)
    return U.transcript(s, c, t, BASE, BASE + 10_000 * HOUR, after=(BASE + 2 * HOUR, "u12", 100), limit=40).select(
        "id", "device_id", "start_utc_ms")


@query("segment_context", f"""
WITH a AS (SELECT s.*, coalesce(ch.value, 'ambient') AS channel FROM v_segments s LEFT JOIN v_channel ch ON ch.segment_id = s.id WHERE s.id = 25), c AS (
SELECT v.id, v.channel FROM v_visible v, a WHERE v.channel <> 'dictation' AND v.device_id = a.device_id
AND v.end_utc_ms >= a.start_utc_ms - 60000 AND v.start_utc_ms <= a.end_utc_ms + 60000)
SELECT id, channel, true AS in_context, id = 25 AS is_anchor FROM c
UNION ALL SELECT id, channel, false, true FROM a WHERE id NOT IN (SELECT id FROM c)""")
def segment_context(spark, d):
    s, _, t = _seg(spark, d)
    return U.segment_context(s, t, 25).select("id", "channel", "in_context", "is_anchor")


@query("session_opening", f"""
WITH m AS (SELECT v.id, v.text, v.start_utc_ms, v.device_id, ss.session_id FROM v_current v JOIN v_seg_sessions ss ON ss.id = v.chunk_id)
SELECT s.session_id, s.device_id, coalesce(n, 0) AS n_visible_segments, o AS opening FROM (SELECT DISTINCT session_id, device_id FROM v_seg_sessions) s
LEFT JOIN (SELECT session_id, count(*) AS n, arg_min(text, start_utc_ms * 1000000 + id) AS o FROM m GROUP BY ALL) USING (session_id)""")
def session_opening(spark, d):
    s, c, t = _seg(spark, d)
    sessions = S.sessions_by_gap(c, 300.0, AS_OF)
    out = U.recall_sessions(sessions, s, c, S.assign_sessions(c, 300.0), t, BASE, BASE + 10_000_000 * HOUR, AS_OF, limit=None)
    return out.select("session_id", "device_id", "n_visible_segments", "opening")


@query("session_semi", """
SELECT DISTINCT ss.session_id FROM v_current v JOIN v_seg_sessions ss ON ss.id = v.chunk_id WHERE v.lang = 'no'""")
def session_semi(spark, d):
    s, c, t = _seg(spark, d)
    sessions = S.sessions_by_gap(c, 300.0, AS_OF)
    return U.recall_sessions(sessions, s, c, S.assign_sessions(c, 300.0), t, BASE, BASE + 10_000_000 * HOUR, AS_OF,
                             limit=None, lang="no").select("session_id")


_DOCS = f"""
WITH s AS (SELECT session_id, device_id, min(session_start) AS a, max(session_end) AS b, count(*) AS n FROM v_seg_sessions GROUP BY ALL),
live AS (SELECT ss.session_id, count(*) AS n FROM v_segments g JOIN v_seg_sessions ss ON ss.id = g.chunk_id WHERE g.superseded_by IS NULL GROUP BY ALL),
lines AS (SELECT ss.session_id, string_agg('[' || strftime(make_timestamp(v.start_utc_ms * 1000), '%H:%M:%S') || '] ' || v.text || chr(10), ''
    ORDER BY v.start_utc_ms, v.chunk_id, v.idx) AS t FROM v_visible v JOIN v_seg_sessions ss ON ss.id = v.chunk_id WHERE v.channel <> 'dictation' GROUP BY ALL)
SELECT session_id, '---' || chr(10) || 'kind: speech-session' || chr(10) || 'session_id: "' || session_id || '"' || chr(10) || 'device_id: "' || device_id || '"' || chr(10)
  || 'date: ' || strftime(make_timestamp(a * 1000), '%Y-%m-%d') || chr(10) || 'start_utc: "' || {iso('a')} || '"' || chr(10) || 'end_utc: "' || {iso('b')} || '"' || chr(10)
  || 'duration_s: ' || CAST(round((b - a) / 1000.0, 3) AS DOUBLE) || chr(10) || 'n_chunks: ' || s.n || chr(10) || 'n_segments: ' || coalesce(live.n, 0) || chr(10)
  || 'closed: ' || CASE WHEN {AS_OF} - b > 300000 THEN 'true' ELSE 'false' END || chr(10) || 'gap_s: 300.0' || chr(10) || 'title: null' || chr(10) || '---' || chr(10) || chr(10)
  || '# ' || device_id || ' ' || {iso('a')} || chr(10) || chr(10) || coalesce(lines.t, '') AS content
FROM s LEFT JOIN live USING (session_id) LEFT JOIN lines USING (session_id)"""


def _documents(spark, d):
    s, c, t = _seg(spark, d)
    sessions = S.sessions_by_gap(c, 300.0, AS_OF, s)
    return R.session_documents(sessions, U.session_rows(s, S.assign_sessions(c, 300.0), t))


@query("session_export", _DOCS)
def session_export(spark, d):
    return _documents(spark, d)


@query("session_export_changed", f"""
SELECT session_id FROM ({_DOCS}) WHERE NOT (ascii(substr(sha256(content), 1, 1)) % 2 = 0)""")
def session_export_changed(spark, d):
    docs = _documents(spark, d)
    # The stored hashes: documents whose hash starts with an even character count as unchanged.
    sha = F.sha2("content", 256)
    stored = docs.where(F.ascii(F.substring(sha, 1, 1)) % 2 == 0).select("session_id", sha.alias("content_sha256"))
    return R.changed_documents(docs, stored).select("session_id")


@query("get_session", f"""
WITH l AS (SELECT ss.session_id, count(*) AS n, string_agg('[' || strftime(make_timestamp(v.start_utc_ms * 1000), '%H:%M:%S') || '] ' || v.text, chr(10)
    ORDER BY v.start_utc_ms, v.chunk_id, v.idx) AS t FROM v_visible v JOIN v_seg_sessions ss ON ss.id = v.chunk_id WHERE v.channel <> 'dictation' GROUP BY ALL)
SELECT s.session_id, coalesce(l.n, 0) AS n_rows, CASE WHEN t IS NULL THEN '' WHEN length(t) <= 400 THEN t ELSE substr(t, 1, 189) || chr(10) || '[... truncated ...]' || chr(10)
  || right(t, 190) END AS text FROM (SELECT DISTINCT session_id FROM v_seg_sessions) s LEFT JOIN l USING (session_id)""")
def get_session(spark, d):
    s, c, t = _seg(spark, d)
    sessions = S.sessions_by_gap(c, 300.0, AS_OF)
    rows = U.session_rows(s, S.assign_sessions(c, 300.0), t)
    return U.get_session(sessions, rows, 400).select("session_id", "n_rows", "text")


@query("recall_items", """
SELECT v.id::VARCHAR AS id, v.chunk_id::VARCHAR AS chunk_id, c.status AS processing_state, CASE WHEN v.span_id IS NULL THEN 'stt' ELSE 'dictation' END AS kind,
  c.path IS NOT NULL AND c.id % 3 <> 0 AS audio_available, coalesce(n, 0) AS n_tags, c.start_utc_ms AS chunk_start_utc_ms
FROM v_current v LEFT JOIN v_seg_chunks c ON c.id = v.chunk_id LEFT JOIN (SELECT segment_id, count(*) AS n FROM v_tags GROUP BY ALL) g ON g.segment_id = v.id""")
def recall_items(spark, d):
    s, c, t = _seg(spark, d)
    rows = VS.policy_rows(s, c, t).select(*s.columns, "channel")
    files = c.where("path is not null and id % 3 <> 0").select("path")
    out = U.items(rows, t, c, audio_files=files)
    return out.select(F.col("segment_id").alias("id"), "chunk_id", "processing_state", F.col("producer.kind").alias("kind"), "audio_available",
                      F.size("tags").alias("n_tags"), "chunk_start_utc_ms")


@query("recall_json", """
SELECT v.id::VARCHAR AS id, v.text, v.lang, v.model_id FROM v_current v""")
def recall_json(spark, d):
    s, c, t = _seg(spark, d)
    rows = VS.policy_rows(s, c, t).select(*s.columns, "channel")
    item = U.as_json(U.items(rows, t, c))
    return item.select(F.get_json_object("item", "$.segment_id").alias("id"), F.get_json_object("item", "$.text").alias("text"),
                       F.get_json_object("item", "$.lang").alias("lang"),
                       F.get_json_object("item", "$.producer.model_id").alias("model_id"))


# ------------------------------------------------------------- span tags


@query("span_tag_scope", """
SELECT s.id AS span_id, t.id AS tag_id FROM v_spans s JOIN v_span_tags t ON t.device_id = s.device_id AND (
  (t.start_utc_ms < s.end_utc_ms AND t.end_utc_ms > s.start_utc_ms)
  OR (t.start_utc_ms = t.end_utc_ms AND t.start_utc_ms >= s.start_utc_ms AND t.start_utc_ms < s.end_utc_ms)
  OR (s.start_utc_ms = s.end_utc_ms AND ((t.start_utc_ms <= s.start_utc_ms AND t.end_utc_ms > s.start_utc_ms)
      OR (t.end_utc_ms = t.start_utc_ms AND t.start_utc_ms = s.start_utc_ms))))""")
def span_tag_scope(spark, d):
    return G.span_tag_scope(V.dictation_spans(spark, d), V.span_tag_rows(spark, d)).select("span_id", "tag_id")


@query("span_tag_map", """
SELECT s.id, t.key || '=' || t.value AS tags FROM v_spans s LEFT JOIN v_span_tags t ON t.device_id = s.device_id
AND t.start_utc_ms = s.start_utc_ms AND t.end_utc_ms = s.end_utc_ms AND t.source = 'deterministic'""")
def span_tag_map(spark, d):
    out = G.span_tag_map(V.dictation_spans(spark, d), V.span_tag_rows(spark, d))
    one = F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("id", F.when(F.col("tags").isNotNull(), F.array_join(one, ",")).alias("tags"))


@query("list_spans", f"""
SELECT id, device_id, {iso('start_utc_ms')} AS start_utc, cancelled FROM v_spans WHERE end_utc_ms >= {BASE + 48 * HOUR} AND start_utc_ms < {BASE + 480 * HOUR}
ORDER BY start_utc_ms DESC, id DESC LIMIT 100""")
def list_spans(spark, d):
    return U.list_spans(V.dictation_spans(spark, d), V.span_tag_rows(spark, d), BASE + 48 * HOUR, BASE + 480 * HOUR,
                        limit=100).select("id", "device_id", "start_utc", "cancelled")


@query("recall_spans", """
SELECT s.id, 'app' || k AS target_app, CAST(NULL AS VARCHAR) AS target_window, 'p' || k AS target_pane, CAST(NULL AS VARCHAR) AS target_program,
  (SELECT count(*) FROM v_span_tags t WHERE t.device_id = s.device_id AND ((t.start_utc_ms < s.end_utc_ms AND t.end_utc_ms > s.start_utc_ms)
    OR (t.start_utc_ms = t.end_utc_ms AND t.start_utc_ms >= s.start_utc_ms AND t.start_utc_ms < s.end_utc_ms)
    OR (s.start_utc_ms = s.end_utc_ms AND ((t.start_utc_ms <= s.start_utc_ms AND t.end_utc_ms > s.start_utc_ms)
      OR (t.end_utc_ms = t.start_utc_ms AND t.start_utc_ms = s.start_utc_ms))))) AS n_tags FROM v_spans s WHERE s.lang = 'en' AND NOT s.cancelled""")
def recall_spans(spark, d):
    out = U.recall_spans(V.dictation_spans(spark, d), V.span_tag_rows(spark, d), BASE, BASE + 10_000 * HOUR, lang="en",
                         cancelled=False, limit=None)
    return out.select("id", "target_app", "target_window", "target_pane", "target_program",
                      F.coalesce(F.size("tag_ids"), F.lit(0)).alias("n_tags"))


_PAIRS = """
SELECT id, 'channel' AS key, 'dictation' AS value FROM v_spans UNION ALL SELECT id, 'mode', mode FROM v_spans
UNION ALL SELECT id, 'app', 'app' || k FROM v_spans UNION ALL SELECT id, 'pane', 'p' || k FROM v_spans
UNION ALL SELECT id, 'cancelled', 'true' FROM v_spans WHERE cancelled"""


def _span_pairs(spark, d):
    # `window` is a number in these bodies, so only text facts are taken.
    return G.span_tag_pairs(with_target_facts(V.dictation_spans(spark, d)))


@query("span_tag_pairs", _PAIRS)
def span_tag_pairs(spark, d):
    return _span_pairs(spark, d).select("id", "key", "value")


# ------------------------------------------------------------- search


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{M}]*')"


def _bm25(f: str, n: str) -> str:
    idf = f"ln((s.nn - {n} + 0.5) / ({n} + 0.5))"
    return f"(CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END) * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * dl / (s.total / s.nn)))"


_LITERAL = f"""
WITH t AS (SELECT id, device_id, start_utc_ms, superseded_by, {_TOKENS} AS tok FROM v_corpus),
c AS (SELECT id, device_id, start_utc_ms, superseded_by, len(tok) AS dl, CAST(len(list_filter(tok, lambda x: x = 'only')) AS DOUBLE) AS f0,
  CAST(len(list_filter(tok, lambda x: x = 'anti')) AS DOUBLE) AS f1 FROM t),
s AS (SELECT CAST(count(*) AS DOUBLE) AS nn, CAST(sum(dl) AS DOUBLE) AS total, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM c)
SELECT id, device_id, start_utc_ms, superseded_by, -({_bm25('f0', 'n0')} + {_bm25('f1', 'n1')}) AS score FROM c, s WHERE f0 > 0 AND f1 > 0"""


@query("search_literal", f"SELECT id, round(score, 6) AS score FROM ({_LITERAL}) WHERE superseded_by IS NULL")
def search_literal(spark, d):
    found = Q.literal_matches(V.search_corpus(spark, d), "only ANTI").where("superseded_by is null")
    return found.select("id", F.round("score", 6).alias("score"))


@query("search_topk", f"""
SELECT id, round(score, 6) AS score FROM ({_LITERAL}) x LEFT JOIN v_channel ch ON ch.segment_id = x.id
WHERE superseded_by IS NULL AND coalesce(ch.value, 'ambient') <> 'dictation' ORDER BY round(score, 9), start_utc_ms, id LIMIT 20""")
def search_topk(spark, d):
    corpus = V.search_corpus(spark, d)
    return U.search(corpus, V.tags(spark, d), "only anti", limit=20).select("id", F.round("score", 6).alias("score"))


@query("search_between", f"""
SELECT id, round(score, 6) AS score FROM ({_LITERAL}) x LEFT JOIN v_channel ch ON ch.segment_id = x.id
WHERE superseded_by IS NULL AND coalesce(ch.value, 'ambient') <> 'dictation' AND start_utc_ms >= {BASE + 370_000} AND start_utc_ms < {BASE + 822_000}
ORDER BY round(score, 9), start_utc_ms, id LIMIT 20 OFFSET 3""")
def search_between(spark, d):
    found = U.search(V.search_corpus(spark, d), V.tags(spark, d), "only anti", BASE + 370_000, BASE + 822_000, limit=20, offset=3)
    return found.select("id", F.round("score", 6).alias("score"))


@query("search_phrase", f"""
WITH t AS (SELECT id, {_TOKENS} AS tok FROM v_corpus),
c AS (SELECT id, len(tok) AS dl, CAST(len(list_filter(range(1, greatest(len(tok), 1)), lambda i: tok[i] = 'of' AND tok[i + 1] = 'the')) AS DOUBLE) AS f0 FROM t),
s AS (SELECT CAST(count(*) AS DOUBLE) AS nn, CAST(sum(dl) AS DOUBLE) AS total, count(*) FILTER (f0 > 0) AS n0 FROM c)
SELECT id, round(-({_bm25('f0', 'n0')}), 6) AS score FROM c, s WHERE f0 > 0""")
def search_phrase(spark, d):
    return Q.literal_matches(V.search_corpus(spark, d), "of-the").select("id", F.round("score", 6).alias("score"))


_FUZZY = f"""
WITH t AS (SELECT id, start_utc_ms, device_id, lower(text) AS low FROM v_corpus),
c AS (SELECT id, start_utc_ms, device_id, low, CAST(greatest(length(low) - 2, 0) AS DOUBLE) AS dl, (length(low) - length(replace(low, 'antion', ''))) / 6.0 AS f0 FROM t),
s AS (SELECT CAST(count(*) AS DOUBLE) AS nn, sum(dl) AS total, count(*) FILTER (f0 > 0) AS n0 FROM c)
SELECT id, start_utc_ms, device_id, -({_bm25('f0', 'n0')}) AS score, low FROM c, s WHERE f0 > 0"""


@query("search_fuzzy", f"SELECT id, round(score, 6) AS score FROM ({_FUZZY}) WHERE contains(low, 'ou')")
def search_fuzzy(spark, d):
    return Q.fuzzy_matches(V.search_corpus(spark, d), "ANTION Ou").select("id", F.round("score", 6).alias("score"))


@query("search_short", """
SELECT id, start_utc_ms FROM v_corpus WHERE contains(lower(text), 'é') AND superseded_by IS NULL
UNION ALL SELECT id, start_utc_ms FROM v_corpus WHERE FALSE""")
def search_short(spark, d):
    return Q.fuzzy_matches(V.search_corpus(spark, d), "É").where("superseded_by is null").select("id", "start_utc_ms")


@query("search_newest", """
SELECT id, start_utc_ms FROM v_corpus WHERE contains(lower(text), 'é') AND superseded_by IS NULL ORDER BY start_utc_ms DESC, device_id, id LIMIT 25""")
def search_newest(spark, d):
    found = Q.fuzzy_matches(V.search_corpus(spark, d), "É").where("superseded_by is null")
    return found.orderBy(*Q.ranked(found, Q.is_scored("É", fuzzy=True))).limit(25).select("id", "start_utc_ms")


@query("search_page", f"""
SELECT id, round(score, 6) AS score, greatest(end_utc_ms, start_utc_ms + 1) AS address_to_ms FROM (SELECT x.*, v.end_utc_ms FROM ({_FUZZY}) x JOIN v_corpus v ON v.id = x.id
  LEFT JOIN v_channel ch ON ch.segment_id = x.id WHERE v.superseded_by IS NULL AND coalesce(ch.value, 'ambient') <> 'dictation')
ORDER BY round(score, 9), start_utc_ms, device_id, id LIMIT 31""")
def search_page(spark, d):
    corpus = V.search_corpus(spark, d)
    rows = corpus.select("*", F.col("id").alias("span_id"), F.col("id").alias("chunk_id"), F.lit("m").alias("model_id"),
                         F.lit("r").alias("model_revision"))
    chunks = corpus.select("id", F.lit("m").alias("model_id"), F.lit("r").alias("model_revision"))
    out = U.recall_search(rows, chunks, V.tags(spark, d), "antion", BASE, BASE + 10_000 * HOUR, fuzzy=True, limit=30)
    return out.select("id", F.round("score", 6).alias("score"), "address_to_ms")


@query("search_postings", f"""
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TOKENS}) AS term FROM v_corpus) GROUP BY ALL) GROUP BY term""")
def search_postings(spark, d):
    return Q.postings(V.search_corpus(spark, d)).groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


# ------------------------------------------------------------- reconciliation


def _first_hit(rows: str, hits: str, cols: str) -> str:
    return f"""SELECT r.id, {cols} FROM {rows} r LEFT JOIN LATERAL (SELECT * FROM {hits} h WHERE h.device_id = r.device_id
      AND h.start_utc_ms < r.end_utc_ms AND h.end_utc_ms > r.start_utc_ms ORDER BY h.start_utc_ms, h.id LIMIT 1) h ON TRUE"""


_LIVE = "(SELECT * FROM v_spans WHERE NOT cancelled)"


@query("span_apply", """
SELECT r.id, arg_min(s.id, s.start_utc_ms * 1000000 + s.id) AS superseded_by FROM v_stt r LEFT JOIN v_spans s ON NOT s.cancelled AND s.device_id = r.device_id
AND s.start_utc_ms < r.end_utc_ms AND s.end_utc_ms > r.start_utc_ms GROUP BY r.id""")
def span_apply(spark, d):
    return RC.superseded(V.stt_rows(spark, d), V.dictation_spans(spark, d))


@query("span_rows", """
WITH hit AS (SELECT s.id, arg_min(c.id, c.start_utc_ms * 1000000 + c.id) AS chunk_id FROM v_spans s LEFT JOIN v_chunks c ON c.device_id = s.device_id
  AND c.start_utc_ms < s.end_utc_ms AND c.end_utc_ms > s.start_utc_ms WHERE NOT s.cancelled GROUP BY s.id)
SELECT s.id AS span_id, hit.chunk_id, coalesce(greatest(0, s.start_utc_ms - c.start_utc_ms), 0) AS offset_ms, s.text, s.engine AS model_id
FROM v_spans s JOIN hit ON hit.id = s.id LEFT JOIN v_chunks c ON c.id = hit.chunk_id""")
def span_rows(spark, d):
    return RC.span_rows(V.dictation_spans(spark, d), V.chunks(spark, d)).select("span_id", "chunk_id", "offset_ms", "text", "model_id")


@query("cancelled_tags", f"""
WITH p AS ({_PAIRS}), o AS (SELECT r.id AS segment_id, p.key, p.value, s.start_utc_ms AS a, s.id AS sid FROM v_stt r JOIN v_spans s ON s.cancelled AND s.device_id = r.device_id
  AND r.start_utc_ms < s.end_utc_ms AND r.end_utc_ms > s.start_utc_ms JOIN p ON p.id = s.id)
SELECT segment_id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, key ORDER BY a, sid) AS rn FROM o) o
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM v_tags t WHERE t.segment_id = o.segment_id AND t.key = o.key)""")
def cancelled_tags(spark, d):
    return RC.cancelled_tags(V.stt_rows(spark, d), V.dictation_spans(spark, d), _span_pairs(spark, d), V.tags(spark, d))


@query("span_cover", """
SELECT c.id AS chunk_id, s.id AS span_id, greatest(0, (s.start_utc_ms - c.start_utc_ms) * 16) AS lo, least(c.n_samples, (s.end_utc_ms - c.start_utc_ms) * 16) AS hi
FROM v_chunks c JOIN v_spans s ON s.device_id = c.device_id AND NOT s.cancelled AND s.start_utc_ms < c.end_utc_ms AND s.end_utc_ms > c.start_utc_ms
WHERE least(c.n_samples, (s.end_utc_ms - c.start_utc_ms) * 16) > greatest(0, (s.start_utc_ms - c.start_utc_ms) * 16)""")
def span_cover(spark, d):
    return RC.masked_ranges(V.chunks(spark, d), V.dictation_spans(spark, d))


@query("masked_time", """
SELECT c.id, CAST(coalesce(sum(CASE WHEN s.id IS NOT NULL THEN least(c.end_utc_ms, s.end_utc_ms) - greatest(c.start_utc_ms, s.start_utc_ms) END), 0) AS BIGINT) AS masked_ms
FROM v_chunks c LEFT JOIN v_spans s ON s.device_id = c.device_id AND NOT s.cancelled AND s.start_utc_ms < c.end_utc_ms AND s.end_utc_ms > c.start_utc_ms GROUP BY c.id""")
def masked_time(spark, d):
    return RC.masked_time(V.chunks(spark, d), V.dictation_spans(spark, d))


@query("covered_chunks", """
SELECT id, masked_ms FROM (SELECT c.id, c.duration_ms, CAST(sum(least(c.end_utc_ms, s.end_utc_ms) - greatest(c.start_utc_ms, s.start_utc_ms)) AS BIGINT) AS masked_ms
FROM v_chunks c JOIN v_spans s ON s.device_id = c.device_id AND NOT s.cancelled AND s.start_utc_ms < c.end_utc_ms AND s.end_utc_ms > c.start_utc_ms GROUP BY ALL)
WHERE masked_ms > 0 AND duration_ms - masked_ms < 1000""")
def covered_chunks(spark, d):
    return RC.covered_chunks(V.chunks(spark, d), V.dictation_spans(spark, d)).select("id", "masked_ms")


def _timed_words(spark, d):
    """STT rows with one word per token, evenly spread, relative to the chunk start (the row's own)."""
    # Counted once per row, outside the lambda, which would count them again for every word.
    s = V.stt_rows(spark, d).withColumn("tokens", F.split("text", " ")).withColumn("n_tokens", F.size("tokens").cast("bigint"))
    length = F.col("end_utc_ms") - F.col("start_utc_ms")
    made = F.transform("tokens", lambda t, i: F.struct(
        F.concat(F.lit(" "), t).alias("w"), F.call_function("div", length * i, F.col("n_tokens")).alias("s"),
        F.call_function("div", length * (i + 1), F.col("n_tokens")).alias("e"), F.lit(0.9).alias("p")))
    return s.withColumn("chunk_start_utc_ms", F.col("start_utc_ms")).withColumn(
        "words", F.when(F.col("id") % 6 != 0, made)).drop("tokens", "n_tokens")


_WORDS = """
w AS (SELECT id, device_id, start_utc_ms AS base, end_utc_ms, i - 1 AS i, tok[i] AS w, (end_utc_ms - start_utc_ms) * (i - 1) // len(tok) AS s,
  (end_utc_ms - start_utc_ms) * i // len(tok) AS e FROM (SELECT *, string_split(text, ' ') AS tok FROM v_stt WHERE id % 6 <> 0), LATERAL (SELECT unnest(range(1, len(tok) + 1)) AS i))"""


@query("split_at_span", f"""
WITH {_WORDS},
own AS (SELECT w.id, w.i, arg_min(sp.id, sp.start_utc_ms * 1000000 + sp.id) AS own FROM w LEFT JOIN v_spans sp ON NOT sp.cancelled AND sp.device_id = w.device_id
  AND sp.start_utc_ms * 2 <= w.base * 2 + w.s + w.e AND w.base * 2 + w.s + w.e < sp.end_utc_ms * 2 GROUP BY w.id, w.i),
r AS (SELECT w.*, own.own, CASE WHEN w.i > 0 AND own.own IS NOT DISTINCT FROM lag(own.own) OVER (PARTITION BY w.id ORDER BY w.i) THEN 0 ELSE 1 END AS f
  FROM w JOIN own ON own.id = w.id AND own.i = w.i),
g AS (SELECT *, sum(f) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS piece FROM r),
p AS (SELECT id, piece, any_value(own) AS superseded_by, min(base + s) AS a, max(base + e) AS b, string_agg(w, ' ' ORDER BY i) AS text FROM g GROUP BY id, piece),
bare AS (SELECT r.id, arg_min(s.id, s.start_utc_ms * 1000000 + s.id) AS superseded_by, any_value(r.start_utc_ms) AS a, any_value(r.end_utc_ms) AS b, any_value(r.text) AS text
  FROM v_stt r LEFT JOIN v_spans s ON NOT s.cancelled AND s.device_id = r.device_id AND s.start_utc_ms < r.end_utc_ms AND s.end_utc_ms > r.start_utc_ms
  WHERE r.id % 6 = 0 GROUP BY r.id)
SELECT id, CAST(piece AS BIGINT) AS piece, a AS start_utc_ms, b AS end_utc_ms, text, superseded_by FROM p UNION ALL SELECT id, 0, a, b, text, superseded_by FROM bare""")
def split_at_span(spark, d):
    return RC.split_at_spans(_timed_words(spark, d), V.dictation_spans(spark, d)).select(
        "id", "piece", "start_utc_ms", "end_utc_ms", "text", "superseded_by")


@query("newest_transcription", """
SELECT id FROM (SELECT *, id % 5 AS batch, id // 20 AS chunk FROM v_segments) r WHERE span_id IS NOT NULL OR batch = (SELECT max(q.id % 5) FROM v_segments q
  WHERE q.span_id IS NULL AND q.id // 20 = r.chunk AND q.model_id = r.model_id)""")
def newest_transcription(spark, d):
    rows = V.segments(spark, d).withColumn("batch", F.col("id") % 5).withColumn("chunk_id", T.floor_div("id", 20))
    return RC.newest_transcription(rows).select("id")


@query("attempt_state", """
WITH o AS (SELECT event_id AS tt, event_id % 900 AS chunk_id, CASE event_type WHEN 'view' THEN 'ok' WHEN 'error' THEN 'requeue' ELSE 'error' END AS event FROM events),
l AS (SELECT chunk_id, max(tt) FILTER (event = 'requeue') AS z FROM o GROUP BY chunk_id)
SELECT chunk_id, CASE WHEN ok > 0 THEN 'done' WHEN bad >= 3 THEN 'failed' ELSE 'pending' END AS status, bad AS attempts FROM (
  SELECT o.chunk_id, count(*) FILTER (event = 'ok' AND (z IS NULL OR tt > z)) AS ok, count(*) FILTER (event = 'error' AND (z IS NULL OR tt > z)) AS bad
  FROM o JOIN l USING (chunk_id) GROUP BY o.chunk_id)""")
def attempt_state(spark, d):
    e = V.table(spark, d, "events").select(
        F.col("event_id").alias("at"), (F.col("event_id") % 900).alias("chunk_id"),
        F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "error", "requeue").otherwise("error").alias("event"))
    return RC.attempt_state(e)


@query("requeue", """
SELECT id, CASE WHEN r THEN 'pending' ELSE status END AS status, CASE WHEN r THEN 0 ELSE attempts END AS attempts, r AS requeued FROM (
  SELECT *, status = 'failed' OR (status = 'pending' AND attempts >= 3) AS r FROM v_chunks)""")
def requeue(spark, d):
    return RC.requeue(V.chunks(spark, d)).select("id", "status", "attempts", "requeued")


# ------------------------------------------------------------- recogniser output


def _window_responses(spark, d):
    """One recogniser reply per packed window of sped-up chunks: a segment per two chunks, a word
    every 0.7 s, some of them in the pauses between chunks."""
    packed = L.pack_windows(dense(spark, d))
    spans = materialise(L.window_spans(packed))
    end = F.element_at("spans", -1)["end"]
    ticks = F.sequence(F.lit(0), F.floor(end / 0.7).cast("int"))
    words = F.transform(ticks, lambda i: F.struct((i * 0.7).alias("start"), (i * 0.7 + 0.5).alias("end"),
                                                  F.concat(F.lit(" w"), i.cast("string")).alias("word"), F.lit(0.5).alias("probability")))
    segs = F.array(F.struct(F.lit(0.0).alias("start"), (end / 2).alias("end"), F.lit("first half").alias("text")),
                   F.struct((end / 2).alias("start"), end.alias("end"), F.lit("second half").alias("text")))
    reply = spans.select("window_id", F.to_json(F.struct(F.lit("no").alias("language"), segs.alias("segments"),
                                                         F.when(F.col("window_id") % 4 != 0, words).alias("words"))).alias("response"))
    return reply, spans


_TICKS = """
sp AS (SELECT window_id, id AS chunk_id, ord, offset_ms / 1000.0::DOUBLE AS o, (offset_ms + duration_ms) / 1000.0::DOUBLE AS e, start_utc_ms, duration_ms FROM pk),
wd AS (SELECT window_id, max(e) AS fin FROM sp GROUP BY 1),
tk AS (SELECT window_id, fin, i, i * 0.7::DOUBLE AS s, i * 0.7::DOUBLE + 0.5::DOUBLE AS e FROM wd, LATERAL (SELECT unnest(range(0, CAST(floor(fin / 0.7::DOUBLE) AS BIGINT) + 1)) AS i) WHERE window_id % 4 <> 0)"""


@query("stt_verbose", """
WITH p AS (SELECT conv_id * 8 + turn AS window_id, string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ') AS tok FROM conversations),
w AS (SELECT window_id, i - 1 AS i, tok[i] AS w, (i - 1) * 0.5::DOUBLE + 0.25::DOUBLE AS mid FROM p, LATERAL (SELECT unnest(range(1, len(tok) + 1)) AS i)),
h AS (SELECT *, CASE WHEN mid <= 1.0 THEN 0 WHEN mid >= 2.0 AND mid <= 3.0 THEN 1 WHEN abs(mid - 1.0) <= abs(mid - 2.0) AND mid < 2.0 THEN 0 ELSE 1 END AS seg FROM w)
SELECT s.window_id, s.seg, string_agg(w, ' ' ORDER BY i) AS words, count(w) AS n FROM (SELECT window_id, unnest([0, 1]) AS seg FROM p) s
LEFT JOIN h ON h.window_id = s.window_id AND h.seg = s.seg GROUP BY s.window_id, s.seg""")
def stt_verbose(spark, d):
    c = V.table(spark, d, "conversations")
    tok = F.split(F.regexp_replace(X.strip("text"), r"\s+", " "), " ")
    words = F.transform(tok, lambda t, i: F.struct(t.alias("word"), (i * 0.5).alias("start"), (i * 0.5 + 0.5).alias("end"),
                                                   F.lit(0.7).alias("score")))
    segs = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit("a").alias("text")),
                   F.struct(F.lit(2.0).alias("start"), F.lit(3.0).alias("end"), F.lit("b").alias("text")))
    replies = c.select((F.col("conv_id") * 8 + F.col("turn")).alias("window_id"),
                       F.to_json(F.struct(segs.alias("segments"), words.alias("words"))).alias("response"))
    out = stt.verbose_segments(replies)
    return out.select("window_id", "seg", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("words"),
                      F.coalesce(F.size("words"), F.lit(0)).alias("n"))


@query("stt_centiseconds", """
SELECT conv_id * 8 + turn AS window_id, s.seg, CASE WHEN s.seg = 0 THEN 0.5 ELSE turn + 0.25 END AS start, CASE WHEN s.seg = 0 THEN 1.5 ELSE turn + 1.0 END AS "end",
  CASE WHEN s.seg = 0 THEN text ELSE role END AS text FROM conversations, (SELECT unnest([0, 1]) AS seg) s""")
def stt_centiseconds(spark, d):
    c = V.table(spark, d, "conversations")
    segs = F.array(
        F.to_json(F.struct(F.lit(0.5).alias("start"), F.lit(1.5).alias("end"), F.col("text").alias("text"))),
        F.to_json(F.struct((F.col("turn") * 100 + 25).alias("t0"), (F.col("turn") * 100 + 100).alias("t1"), F.col("role").alias("text"))))
    replies = c.select((F.col("conv_id") * 8 + F.col("turn")).alias("window_id"),
                       F.concat(F.lit('{"segments":['), F.array_join(segs, ","), F.lit("]}")).alias("response"))
    return stt.centisecond_segments(replies).select("window_id", "seg", "start", "end", "text")


@query("words_to_chunk", f"""
WITH RECURSIVE {QUERIES_SQL_PACK}, {_TICKS},
best AS (SELECT tk.window_id, tk.i, tk.s, tk.e, tk.fin, sp.chunk_id, sp.ord, sp.o, sp.start_utc_ms, sp.duration_ms, row_number() OVER (PARTITION BY tk.window_id, tk.i
    ORDER BY NOT (sp.o <= (tk.s + tk.e) / 2 AND (tk.s + tk.e) / 2 < sp.e), CASE WHEN sp.o <= (tk.s + tk.e) / 2 AND (tk.s + tk.e) / 2 < sp.e THEN 0
      ELSE least(abs(sp.o - (tk.s + tk.e) / 2), abs(sp.e - (tk.s + tk.e) / 2)) END, sp.ord) AS rn FROM tk JOIN sp ON sp.window_id = tk.window_id),
wrd AS (SELECT *, CASE WHEN (s + e) / 2 <= fin / 2 THEN 0 ELSE 1 END AS seg FROM best WHERE rn = 1),
agg AS (SELECT window_id, seg, chunk_id, count(*) AS n_words, string_agg('w' || i, ' ' ORDER BY i) AS wtext, count(*) OVER (PARTITION BY window_id, seg) AS np FROM wrd GROUP BY window_id, seg, chunk_id)
SELECT window_id, seg, chunk_id, n_words, CASE WHEN np > 1 THEN wtext WHEN seg = 0 THEN 'first half' ELSE 'second half' END AS text FROM agg""")
def words_to_chunk(spark, d):
    reply, spans = _window_responses(spark, d)
    segs = stt.verbose_segments(reply)
    out = TR.map_to_chunks(segs, spans.select("window_id", "spans")).where("words is not null")
    return out.select("window_id", "seg", "chunk_id", F.size("words").alias("n_words"), "text")


@query("words_to_chunk_rows")
def words_to_chunk_rows(spark, d):
    reply, spans = _window_responses(spark, d)
    out = TR.map_to_chunks(stt.verbose_segments(reply), spans.select("window_id", "spans"))
    return TR.renumber(out).select("window_id", "chunk_id", "idx", "start_utc_ms", "end_utc_ms", "offset_ms", "text")


_KEEP = """length(trim(text)) > 0 AND (avg_logprob IS NULL OR avg_logprob >= -1.0) AND (compression_ratio IS NULL OR compression_ratio <= 2.4)
  AND (no_speech_prob IS NULL OR no_speech_prob <= 0.6) AND NOT starts_with(ltrim(lower(trim(text)), '"''«»„“”-–— '), 'teksting av')
  AND NOT starts_with(ltrim(lower(trim(text)), '"''«»„“”-–— '), 'takk for at du så på') AND NOT starts_with(ltrim(lower(trim(text)), '"''«»„“”-–— '), 'thank you for watching')"""


@query("quality_filter", f"SELECT id FROM v_mapped WHERE {_KEEP}")
def quality_filter(spark, d):
    return V.mapped_rows(spark, d).where(TR.keep_row()).select("id")


@query("dropped_counts", f"SELECT chunk_id, count(*) AS n_dropped FROM v_mapped WHERE NOT ({_KEEP}) GROUP BY chunk_id")
def dropped_counts(spark, d):
    return TR.dropped_counts(V.mapped_rows(spark, d))


@query("boilerplate", """
SELECT doc_id, starts_with(ltrim(lower(trim(text)), '"''«»„“”-–— '), 'the') OR starts_with(ltrim(lower(trim(text)), '"''«»„“”-–— '), 'la') AS flagged FROM documents""")
def boilerplate(spark, d):
    return V.table(spark, d, "documents").select("doc_id", X.is_boilerplate("text", ("«The", "la")).alias("flagged"))


def _unit_words(spark, d):
    """Conversation rows with their tokens as absolute timed words; every ninth row has one token that
    does not occur in the text, every tenth a word out of order."""
    s = V.words(spark, d)
    made = F.transform("tokens", lambda t, i: F.struct(
        F.when((F.col("id") % 9 == 0) & (i == 2), "@@").otherwise(t).alias("w"),
        (F.call_function("div", F.col("n_ms") * i, F.col("n_tokens")) - F.when((F.col("id") % 10 == 0) & (i == 1), 5).otherwise(0)).alias("s"),
        F.call_function("div", F.col("n_ms") * (i + 1), F.col("n_tokens")).alias("e"), F.lit(0.9).alias("p")))
    return s.withColumn("words", made)


@query("word_timing", """
WITH t AS (SELECT id, start_utc_ms, end_utc_ms, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS tok FROM v_segments)
SELECT id, CASE WHEN len(tok) = 0 THEN 'segment' WHEN id % 10 = 0 AND len(tok) > 1 THEN 'segment' ELSE 'word' END AS timing FROM t""")
def word_timing(spark, d):
    rows = _unit_words(spark, d)
    timed = TR.word_timing("words", "start_utc_ms", "start_utc_ms", "end_utc_ms")
    return rows.select("id", TR.timing_kind(timed).alias("timing"))


def _units(spark, d):
    rows = _unit_words(spark, d)
    timed = TR.word_timing("words", "start_utc_ms", "start_utc_ms", "end_utc_ms")
    units = TR.aligned_units(rows.withColumn("words", timed))
    return units.select("id", "device_id", "conv_id", "text", F.posexplode("units").alias("i", "u"))


@query("unit_alignment", """
WITH t AS (SELECT id, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS tok FROM v_segments)
SELECT id, CASE WHEN len(tok) = 0 OR (id % 10 = 0 AND len(tok) > 1) OR (id % 9 = 0 AND len(tok) > 2) THEN 1 ELSE len(tok) END AS n_units, text AS joined FROM t""")
def unit_alignment(spark, d):
    return _units(spark, d).groupBy("id").agg(
        F.count("*").alias("n_units"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.col("u.text").alias("t")))), lambda x: x["t"]), "").alias("joined"))


@query("unit_sentences", """
WITH t AS (SELECT id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w,
    unnest(range(0, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')))) AS i FROM v_segments),
f AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(w, '[.!?…]["''»”)]?\\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM t)
SELECT id, CAST(sentence AS BIGINT) AS sentence, count(*) AS n_units FROM f GROUP BY ALL""")
def unit_sentences(spark, d):
    from ..operators.selection import sentence_numbers
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    units = V.segments(spark, d).select(F.col("id").alias("segment_id"), F.posexplode(words).alias("i", "text"))
    return sentence_numbers(units).groupBy(F.col("segment_id").alias("id"), "sentence").agg(F.count("*").alias("n_units"))


@query("selection_clip", """
SELECT conv_id, device_id, min(start_utc_ms) AS from_ms, max(end_utc_ms) AS to_ms, string_agg(text, chr(10) ORDER BY start_utc_ms, id) AS quoted_text
FROM v_segments GROUP BY ALL""")
def selection_clip(spark, d):
    from ..operators.selection import clips
    s = V.segments(spark, d).select(F.col("conv_id").alias("selection_id"), "device_id", F.col("id").alias("segment_id"),
                                    "start_utc_ms", "end_utc_ms", "text")
    return clips(s).select(F.col("selection_id").alias("conv_id"), "device_id", "from_ms", "to_ms", "quoted_text")


@query("selection_bounds", """
SELECT device_id, start_utc_ms // 3600000 AS hour, min(start_utc_ms) AS from_ms, max(end_utc_ms) AS to_ms, count(*) AS n_units FROM v_segments GROUP BY ALL""")
def selection_bounds(spark, d):
    from ..operators.selection import bounds
    return bounds(V.segments(spark, d), "hour").select(
        "device_id", F.col("group_key").cast("bigint").alias("hour"), "from_ms", "to_ms", "n_units")


_WORDS = """
w AS (SELECT s.id, s.device_id, s.chunk_id, s.conv_id, s.text AS whole, s.start_utc_ms AS a, unnest(list_filter(string_split_regex(s.text, '\\s+'), lambda x: x <> '')) AS word,
    unnest(range(0, len(list_filter(string_split_regex(s.text, '\\s+'), lambda x: x <> '')))) AS i FROM v_segments s),
u AS (SELECT *, a + 100 * i AS start_utc_ms, a + 100 * i + 100 AS end_utc_ms,
    CAST(coalesce(sum(CASE WHEN regexp_matches(word, '[.!?…]["''»”)]?\\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sentence FROM w)"""

def _word_units(spark, d):
    """The words of transcript rows, a tenth of a second each."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    start = F.col("start_utc_ms") + 100 * F.col("i")
    units = V.segments(spark, d).select(F.col("id").alias("segment_id"), "device_id", "chunk_id", "conv_id", "start_utc_ms", F.posexplode(words).alias("i", "text"))
    return units.withColumn("end_utc_ms", start + 100).withColumn("start_utc_ms", start)

@query("selection_precisions", f"""
WITH {_WORDS}, k AS (SELECT u.*, ss.session_id FROM u LEFT JOIN v_seg_sessions ss ON ss.id = u.chunk_id AND u.chunk_id % 5 <> 0)
SELECT p AS "precision", device_id, CASE p WHEN 'word' THEN id || '/' || i WHEN 'sentence' THEN id || '/' || sentence WHEN 'segment' THEN id::VARCHAR WHEN 'hour' THEN (start_utc_ms // 3600000)::VARCHAR
  ELSE coalesce(session_id, id::VARCHAR) END AS group_key, min(start_utc_ms) AS from_ms, max(end_utc_ms) AS to_ms, count(*) AS n_units
FROM k, (VALUES ('word'), ('sentence'), ('segment'), ('hour'), ('session')) AS v(p) GROUP BY ALL""")
def selection_precisions(spark, d):
    from ..operators.selection import PRECISIONS, bounds, sentence_numbers
    _, c, _ = _seg(spark, d)
    sessions = S.assign_sessions(c, 300.0).where("id % 5 <> 0").select(F.col("id").alias("chunk_id"), "session_id")
    units = sentence_numbers(_word_units(spark, d)).join(sessions, "chunk_id", "left")
    out = [bounds(units, p).withColumn("precision", F.lit(p)) for p in PRECISIONS]
    return reduce(lambda x, y: x.unionByName(y), out)

@query("unit_clip", f"""
WITH {_WORDS}, p AS (SELECT conv_id, device_id, id, a, min(start_utc_ms) AS b, max(end_utc_ms) AS e, CASE WHEN id % 3 = 0 AND max(i) >= 0 AND min(i) > 0 THEN string_agg(word, ' ' ORDER BY i) ELSE any_value(whole) END AS t
  FROM u WHERE id % 3 <> 0 OR i >= 2 GROUP BY conv_id, device_id, id, a)
SELECT conv_id, device_id, min(b) AS from_ms, max(e) AS to_ms, string_agg(t, chr(10) ORDER BY a, id) AS quoted_text FROM p GROUP BY ALL""")
def unit_clip(spark, d):
    from ..operators.selection import unit_clips
    units = _word_units(spark, d)
    rows = units.groupBy("segment_id").agg(F.count("*").alias("n_units")).join(
        V.segments(spark, d).select(F.col("id").alias("segment_id"), "text", "start_utc_ms"), "segment_id")
    chosen = units.where("segment_id % 3 <> 0 or i >= 2").withColumn("text", F.concat("text", F.lit(" "))).withColumnRenamed("conv_id", "selection_id")
    return unit_clips(chosen, rows).withColumnRenamed("selection_id", "conv_id")


# ------------------------------------------------------------- as-of


@query("asof_anchor", """
SELECT e.event_id, a.event_id AS anchor_id, a.start_utc_ms + (e.start_utc_ms - a.start_utc_ms) AS mapped_ms FROM v_events e
ASOF LEFT JOIN (SELECT * FROM v_events WHERE event_type = 'signup') a ON a.device_id = e.device_id AND a.start_utc_ms <= e.start_utc_ms""")
def asof_anchor(spark, d):
    e = V._events(spark, d)
    anchors = e.where("event_type = 'signup'").select("device_id", F.col("start_utc_ms").alias("ref_ms"), F.col("event_id").alias("anchor_id"))
    out = I.as_of(e.select("event_id", "device_id", "start_utc_ms"), anchors, ["device_id"], "start_utc_ms", "ref_ms",
                  ["ref_ms", "anchor_id"], tie="anchor_id")
    return out.select("event_id", F.col("hit.anchor_id").alias("anchor_id"),
                      (F.col("hit.ref_ms") + (F.col("start_utc_ms") - F.col("hit.ref_ms"))).alias("mapped_ms"))


@query("asof_unit", """
SELECT e.event_id, s.id AS unit_id FROM (SELECT event_id, 'u' || (user_id % 20) AS device_id, start_utc_ms FROM v_events) e
ASOF LEFT JOIN v_segments s ON s.device_id = e.device_id AND s.start_utc_ms <= e.start_utc_ms""")
def asof_unit(spark, d):
    e = V._events(spark, d).select("event_id", F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("device_id"), "start_utc_ms")
    s = V.segments(spark, d).select("device_id", F.col("start_utc_ms").alias("unit_ms"), F.col("id").alias("unit_id"))
    return I.as_of(e, s, ["device_id"], "start_utc_ms", "unit_ms", ["unit_id"]).select("event_id", F.col("hit.unit_id").alias("unit_id"))


@query("next_row", """
WITH p AS (SELECT s.id, s.device_id, s.start_utc_ms, c.start_utc_ms AS cs FROM v_segments s JOIN v_seg_chunks c ON c.id = s.chunk_id AND c.path IS NOT NULL)
SELECT c.id AS chunk_id, arg_min(p.id, p.cs * 100000 + (p.start_utc_ms - p.cs)) AS next_id FROM v_seg_chunks c LEFT JOIN p ON p.device_id = c.device_id AND p.cs > c.start_utc_ms GROUP BY c.id""")
def next_row(spark, d):
    from ..operators.selection import next_playable
    s, c, _ = _seg(spark, d)
    return next_playable(s, c).select("chunk_id", "next_id")
