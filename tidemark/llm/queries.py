"""The registered queries of the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import quality_mil, toxicity_crf
from .bpe_chunks import encode_decode
from .decontam import contamination
from .licenses import NOTICES, SPELLINGS, known_notices, license_scan
from .line_dedup import dedup_lines
from .neardup import near_duplicates
from .ngram_lm import score_texts
from .phrases import collocations
from .repairs import damage, repair_conversations
from .sampling import fold
from .token_counts import token_counts
from .topk import top_k
from .warc import archive_round_trip

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), known_notices(spark))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), fold("doc_id", 10) != 0)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_mil.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return quality_mil.score(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_crf.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return toxicity_crf.score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "spans")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), top=2000, min_count=10)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_topk_search, op2_bpe_round_trip, op3_warc_round_trip, op4_license_scan, op5_near_duplicates, op6_ngram_scores, op7_quality_mil,
    op8_decontamination, op9_token_counts, op10_toxicity_crf, op11_line_dedup,
    op12_collocations, op13_conversation_repair)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _license_form(column: str) -> str:
    c = rf"regexp_replace(lower({column}), '(?m)^\W*(copyright\b|\(c\)|©).*$', ' ', 'g')"
    c = rf"trim(regexp_replace({c}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    for said, same in SPELLINGS:
        c = rf"regexp_replace({c}, '\b{said}\b', '{same}', 'g')"
    return c


def _edit(path: str, cost: int | str, letter: str) -> str:
    """A path, seven digits of cost and its edits, with one edit more."""
    return f"lpad((substr({path}, 1, 7)::INT + {cost})::VARCHAR, 7, '0') || substr({path}, 8) || '{letter}'"


def _edit_step() -> str:
    """Best paths by state (nothing, system, user, assistant) after a row, as a fold over rows; least() passes over nulls."""
    to_user = "least(acc.s0, acc.s1, acc.s3)"
    inserted = f"struct_pack(l := r.l, s0 := acc.s0, s1 := acc.s1, s2 := least(acc.s2, {_edit(to_user, 2, 'I')}), s3 := acc.s3)"
    both = f"struct_pack(l := acc.l, s0 := acc.s0, s1 := acc.s1, s2 := acc.s2, s3 := least(acc.s3, {_edit('acc.s2', 2, 'I')}))"
    more = "(CASE WHEN acc.l IN ('S', 'U', 'A', 'X') THEN 1 ELSE 0 END)"

    def own(letter: str, path: str) -> str:
        return f"CASE WHEN lower(acc.l) = '{letter}' THEN {_edit(path, more, 'K')} END"

    def rerole(path: str) -> str:
        return f"CASE WHEN acc.l <> 'd' THEN {_edit(path, f'2 + {more}', 'R')} END"

    edited = (f"struct_pack(l := acc.l, s0 := {_edit('acc.s0', 3, 'D')}, s1 := least({_edit('acc.s1', 3, 'D')}, {own('s', 'acc.s0')}), "
              f"s2 := least({_edit('acc.s2', 3, 'D')}, {own('u', to_user)}, {rerole(to_user)}), "
              f"s3 := least({_edit('acc.s3', 3, 'D')}, {own('a', 'acc.s2')}, {rerole('acc.s2')}))")
    return f"list_transform(list_transform([{inserted}], lambda acc: {both}), lambda acc: {edited})[1]"


_SAID = "coalesce({}::VARCHAR, ' ')"

ORACLES: dict[str, str] = {
    "op1_topk_search": """
        WITH parts AS (SELECT vec_id, generate_subscripts(embedding, 1) AS d, floor(1024 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM embeddings),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
                   FROM parts q JOIN parts c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op3_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        m AS (SELECT page_id, html, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS last FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM m""",
    "op4_license_scan": f"""
        WITH known(license, form) AS (SELECT min(l), f FROM (SELECT l, {_license_form('t')} AS f FROM (VALUES
            {', '.join(f"('{a}', '{b}')" for a, b in NOTICES)}) AS v(l, t)) GROUP BY f),
        lines AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n|\\r')) AS line FROM documents),
        found AS (SELECT doc_id, license FROM lines JOIN known ON {_license_form('line')} = form),
        by_doc AS (SELECT doc_id, count(*)::BIGINT AS n_lines, array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses FROM found GROUP BY doc_id)
        SELECT d.doc_id, k.license AS whole_license, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(licenses, '') AS licenses
        FROM documents d LEFT JOIN known k ON {_license_form("coalesce(text, '')")} = k.form LEFT JOIN by_doc b ON b.doc_id = d.doc_id""",
    "op5_near_duplicates": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (
                SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
        comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
        FROM comp c LEFT JOIN n ON n.doc_id = c.doc_id""",
    "op8_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS t FROM (
                SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM windows),
        places AS (SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS t FROM (
                SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS s FROM d JOIN sizes ON len(w) >= size)),
        hits AS (SELECT doc_id, item_id, p.size, s FROM places p JOIN windows x ON x.size = p.size AND x.t = p.t),
        covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS pos FROM hits) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id""",
    "op11_line_dedup": """
        WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut),
        keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
        often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        judged AS (SELECT doc_id, pos, line, o.k IS NOT NULL AND doc_id <> o.last AS gone FROM keyed LEFT JOIN often o ON keyed.k = o.k)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op12_collocations": f"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        numbered AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        placed AS (SELECT lang, p, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM numbered),
        runs AS (SELECT lang, w1, lead(w1) OVER run AS w2, lead(w1, 2) OVER run AS w3 FROM placed WINDOW run AS (PARTITION BY p ORDER BY i)),
        one AS (SELECT lang, w1 AS g, count(*) AS n FROM runs GROUP BY ALL),
        two AS (SELECT lang, w1, w2, w1 || ' ' || w2 AS g, count(*) AS n FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        three AS (SELECT lang, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3 AS g, count(*) AS n FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        cuts AS (SELECT c.lang, c.g, c.n AS a, 1 AS k, x.n AS l, y.n AS r FROM two c JOIN one x ON x.lang = c.lang AND x.g = w1 JOIN one y ON y.lang = c.lang AND y.g = w2
                 UNION ALL SELECT c.lang, c.g, c.n, 1, x.n, y.n FROM three c JOIN one x ON x.lang = c.lang AND x.g = c.w1 JOIN two y ON y.lang = c.lang AND y.g = c.w2 || ' ' || w3
                 UNION ALL SELECT c.lang, c.g, c.n, 2, x.n, y.n FROM three c JOIN two x ON x.lang = c.lang AND x.g = c.w1 || ' ' || c.w2 JOIN one y ON y.lang = c.lang AND y.g = w3),
        scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
        least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        held AS (SELECT lang, g, max(n) AS n FROM (SELECT lang, w1 || ' ' || w2 AS g, n FROM three UNION ALL SELECT lang, w2 || ' ' || w3, n FROM three) GROUP BY ALL),
        kept AS (SELECT c.* FROM least_cut c LEFT JOIN held h ON h.lang = c.lang AND h.g = c.g WHERE h.n IS NULL OR 100 * h.n < 50 * a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept),
        totals AS (SELECT lang, sum(n) AS n FROM one GROUP BY lang)
        SELECT r.lang, rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r.r::BIGINT AS r, t.n::BIGINT AS n, score::BIGINT AS score
        FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000""",
    "op13_conversation_repair": f"""
        WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(256) AS r(i) UNION ALL
                SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
        said AS (SELECT conv_id, turn, {_SAID.format('role')} AS role, {_SAID.format('text')} AS text,
                        {_SAID.format('conv_id')} || ':' || {_SAID.format('turn')} AS key FROM conversations),
        summed AS (SELECT s.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT)),
                        lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295::BIGINT) % 20 AS kind FROM said s, crc),
        damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
                    FROM summed, range(2) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS nr FROM damaged),
        seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nr) > 1 AS again,
                        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
                        lag(role) OVER (PARTITION BY conv_id ORDER BY nr) AS previous FROM numbered),
        judged AS (SELECT *, bare = '' AS is_blank, bare <> '' AND again AS is_copy, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS is_short,
                        CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS letter FROM seen),
        talks AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank,
                        count(*) FILTER (is_copy) AS duplicate, count(*) FILTER (is_short) AS truncated,
                        count(*) FILTER (previous IS NOT NULL AND previous[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal,
                        list_reduce(list_prepend(struct_pack(l := '', s0 := '0000000', s1 := NULL::VARCHAR, s2 := NULL::VARCHAR, s3 := NULL::VARCHAR),
                            list(struct_pack(l := CASE WHEN is_blank OR is_copy THEN 'd' WHEN is_short THEN upper(letter) ELSE letter END,
                                 s0 := NULL::VARCHAR, s1 := NULL::VARCHAR, s2 := NULL::VARCHAR, s3 := NULL::VARCHAR) ORDER BY nr)), lambda acc, r: {_edit_step()}) AS e
                  FROM judged GROUP BY conv_id),
        ended AS (SELECT *, least(e.s0, e.s3, {_edit("least(e.s2, " + _edit('least(e.s0, e.s1, e.s3)', 2, 'I') + ")", 2, 'I')}) AS best FROM talks),
        paths AS (SELECT *, substr(best, 1, 7)::BIGINT AS cost, substr(best, 8) AS audit FROM ended),
        edits AS (SELECT conv_id, i, substr(audit, i, 1) AS edit, len(replace(substr(audit, 1, i), 'I', '')) AS nr,
                        len(replace(substr(audit, 1, i), 'D', '')) AS place FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS i FROM paths)),
        stands AS (SELECT t.conv_id, i, place, edit, role, text, bool_or(edit = 'K' AND place = 1 AND letter = 's') OVER (PARTITION BY t.conv_id) AS led
                   FROM edits t LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM t.conv_id AND j.nr = t.nr AND edit <> 'I' WHERE edit <> 'D'),
        turns AS (SELECT conv_id, i, CASE WHEN edit = 'K' THEN role WHEN (place - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
                        || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line FROM stands),
        told AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY i) AS whole FROM turns GROUP BY conv_id),
        every_one AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
               sha256(coalesce(whole, '')) AS repaired_sha256
        FROM every_one c LEFT JOIN paths p ON p.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
