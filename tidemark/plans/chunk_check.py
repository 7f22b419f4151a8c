"""SQL of the speech chunk rules: quiet stretches as lists, a chunk a step of a recursion."""

from __future__ import annotations

from ..functions.speech import Rules


def chunk_sql(windows: str, rules: Rules, key: str = "stream") -> str:
    """SQL for the chunks of `windows`, a query that gives (key, idx, prob)."""
    w, r = rules.window, rules

    def grid(x: str) -> str:
        return f"(({x}) + {w - 1}) // {w} * {w}"

    def heard(by: str) -> str:
        return f"len(list_filter(t_speech, lambda x: x.b > start AND x.a + {w} <= {by})) > 0"

    def kept(stop: str, by: str) -> str:
        return f"CASE WHEN speech < 0 THEN {heard(by)} ELSE {stop} - speech >= {r.min_speech} END"

    return f"""
WITH RECURSIVE w AS ({windows}),
k AS (SELECT {key}, idx, CASE WHEN prob >= {r.threshold} THEN 2 WHEN prob < {r.neg_threshold} THEN 0 ELSE 1 END AS kind FROM w),
f AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY {key} ORDER BY idx) THEN 0 ELSE 1 END AS f FROM k),
g AS (SELECT *, sum(f) OVER (PARTITION BY {key} ORDER BY idx ROWS UNBOUNDED PRECEDING) AS g FROM f),
runs AS (SELECT {key}, kind, min(idx) * {w} AS lo, (max(idx) + 1) * {w} AS hi FROM g GROUP BY {key}, g, kind),
talk AS (SELECT {key}, lo AS a, hi AS b, coalesce(lead(lo) OVER (PARTITION BY {key} ORDER BY lo), 1152921504606846976) AS back FROM runs WHERE kind = 2),
hush AS (SELECT {key}, lo AS u, hi AS v FROM runs WHERE kind = 0),
first_hush AS (SELECT t.{key}, h.u AS q, t.back FROM talk t ASOF JOIN hush h ON h.{key} = t.{key} AND h.u >= t.b WHERE h.u < t.back),
stretch AS (SELECT s.{key}, s.q, s.back, CASE WHEN h.u < s.back THEN greatest({grid(f's.q + {r.min_silence}')}, h.u + {w}) END AS c
            FROM first_hush s ASOF LEFT JOIN hush h ON h.{key} = s.{key} AND h.v >= s.q + {r.min_silence}),
tape AS (SELECT e.{key}, e.fin, t.l AS t_speech, h.l AS t_hush, s.l AS t_quiet FROM (SELECT {key}, max(hi) AS fin FROM runs GROUP BY {key}) e
         LEFT JOIN (SELECT {key}, list({{'a': a, 'b': b}} ORDER BY a) AS l FROM talk GROUP BY {key}) t ON t.{key} = e.{key}
         LEFT JOIN (SELECT {key}, list({{'u': u, 'v': v}} ORDER BY u) AS l FROM hush GROUP BY {key}) h ON h.{key} = e.{key}
         LEFT JOIN (SELECT {key}, list({{'q': q, 'back': back, 'c': c}} ORDER BY q) AS l FROM stretch GROUP BY {key}) s ON s.{key} = e.{key}),
walk AS (
  SELECT {key}, NULL::BIGINT AS start, 0::BIGINT AS speech, 0::BIGINT AS now, 0::BIGINT AS floor, NULL::BIGINT AS n_start, NULL::BIGINT AS n_end, NULL::VARCHAR AS cut_reason FROM tape
  UNION ALL
  SELECT {key}, new_start, new_speech, new_now, CASE WHEN got IS NULL THEN floor ELSE got_end END, got, CASE WHEN got IS NOT NULL THEN got_end END, CASE WHEN got IS NOT NULL THEN got_reason END FROM (
    SELECT {key}, floor, CASE WHEN start IS NULL THEN greatest(p - {r.pad}, floor) WHEN closes OR ended THEN NULL ELSE cut END AS new_start,
      CASE WHEN start IS NULL THEN p ELSE -1 END AS new_speech, CASE WHEN start IS NULL THEN p + {w} WHEN closes THEN t_at WHEN ended THEN 1152921504606846976 ELSE cap END AS new_now,
      CASE WHEN start IS NULL THEN NULL WHEN ended THEN CASE WHEN ({kept('last_stop', 'fin')}) AND last_end > start THEN start END
           WHEN closes THEN CASE WHEN {kept('zbase', 't_at')} THEN start END ELSE start END AS got,
      CASE WHEN ended THEN last_end WHEN closes THEN zbase + {r.pad} ELSE cut END AS got_end,
      CASE WHEN ended THEN 'shutdown' WHEN closes THEN 'silence' ELSE 'cap' END AS got_reason
    FROM (
      SELECT *, t_at IS NOT NULL AND t_at <= cap AS closes, NOT (t_at IS NOT NULL AND t_at <= cap) AND fin < cap AS ended,
        CASE WHEN len(cands) > 0 THEN -list_max(cands)[2] + list_max(cands)[1] // 2 ELSE start + {r.max_len} END AS cut,
        CASE WHEN tail.q < fin THEN least(fin, greatest(tail.q, start) + {r.pad}) ELSE fin END AS last_end,
        CASE WHEN tail.q < fin THEN greatest(tail.q, start) ELSE fin END AS last_stop
      FROM (
        SELECT *, coalesce(at1, nxt.c) AS t_at, CASE WHEN at1 IS NOT NULL THEN base ELSE nxt.q END AS zbase,
          list_filter(list_transform(list_filter(t_quiet, lambda s: (s.q >= start OR s.q = run.q) AND s.q + {w} <= cap),
            lambda s: [least(s.back, cap) - greatest(s.q, start), -greatest(s.q, start)]), lambda c: c[1] >= {r.min_pause} AND c[1] // 2 - c[2] > start) AS cands
        FROM (
          SELECT *, CASE WHEN sil.u < run.back THEN greatest({grid('need')}, sil.u + {w}) END AS at1
          FROM (
            SELECT *, list_filter(t_hush, lambda h: h.v >= need)[1] AS sil, list_filter(t_quiet, lambda s: s.q > run.q AND s.c IS NOT NULL)[1] AS nxt
            FROM (
              SELECT *, greatest(run.q, start) AS base, greatest(greatest(run.q, start) + {r.min_silence}, now + 1) AS need
              FROM (
                SELECT walk.*, tape.* EXCLUDE ({key}), CASE WHEN start IS NULL THEN list_filter(t_speech, lambda x: x.a >= now)[1].a END AS p,
                  greatest(now + {w}, {grid(f'start + {r.max_len}')}) AS cap, list_filter(t_quiet, lambda s: s.back > now - {w})[1] AS run,
                  list_filter(t_quiet, lambda s: s.back > fin - {w})[1] AS tail
                FROM walk JOIN tape ON tape.{key} = walk.{key} WHERE now < 1152921504606846976) WHERE start IS NOT NULL OR p IS NOT NULL)))))))
SELECT {key}, n_start, n_end, cut_reason FROM walk WHERE n_start IS NOT NULL"""
