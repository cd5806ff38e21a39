"""SQL for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from weftmat.llm import licenses

_WORD = r"[^\x20\x09-\x0D]+"

EXACT = """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

NEAR = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[p:p + 4] END AS g
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
          JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
    SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, documents.doc_id = c.c AS kept
    FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) c USING (doc_id)"""

RULES = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ln FROM documents),
    p AS (SELECT doc_id, w[p:p + 7] AS k, p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
    h AS (SELECT doc_id, k FROM p GROUP BY ALL HAVING count(*) > 1),
    m AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM p JOIN h USING (doc_id, k), range(8) t(o) GROUP BY doc_id),
    f AS (SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(w, 'string_agg', '')) AS BIGINT) AS wc, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(len(ln) AS BIGINT) AS n_lines, CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, coalesce(m.n, 0) AS n_repeat_words, len(list_distinct(w)) AS nd FROM d LEFT JOIN m USING (doc_id)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
    SELECT doc_id, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR (n_dup_lines >= 5 AND n_dup_lines * 100 > n_lines * 30) OR (n_words < 2000 AND nd * 4 < n_words) OR n_symbols * 10 > n_words
                OR (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) * 100 > length(t) * 40 OR coalesce(wc, 0) < n_words * 2 OR coalesce(wc, 0) > n_words * 25) AS kept
    FROM b"""

_NAME = "CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 WHEN 'system' THEN 6 WHEN 'tool' THEN 4 END"
CHAT = rf"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
    r AS (SELECT *, {_NAME} + 14 + length(text) + CASE WHEN contains(text, '</turn>') OR contains(text, '### ') THEN 1 + length(text) - length(replace(text, '\', ''))
            + length(text) - length(replace(text, '###', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 ELSE 0 END AS size FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
    FROM r GROUP BY conv_id"""


def _license_sql() -> str:
    """The sentences and rules are shared data; cutting, normalising and matching are written anew.

    Ends are first turned into marks: chr(2) ends a sentence, chr(10) within one ends a line. A sentence that is unknown as a
    whole counts by its known lines. A rule matches if its identifiers follow one another at growing places, found step by step.
    """
    known = ", ".join(f"('{s}', '{i}')" for s, i in licenses.KNOWN.items())
    names = list(dict.fromkeys(n for n, _ in licenses.RULES))
    rules = ", ".join(f"({names.index(n)}, '{n}', {list(r)!r})" for n, r in licenses.RULES)
    norm = r"trim(regexp_replace({}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return rf"""
    WITH RECURSIVE k(s, id) AS (VALUES {known}), ru(ord, name, want) AS (VALUES {rules}),
    d AS (SELECT doc_id, rowid AS r, regexp_replace(regexp_replace(lower(coalesce(text, '')), '[.!?:;]+([ 	
]+|\z)', chr(2), 'g'), '
[ 	
*#/]*
', chr(2), 'g') AS t
          FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
    w AS (SELECT r, p AS pos, s FROM (SELECT r, unnest(string_split(t, chr(2))) AS s, generate_subscripts(string_split(t, chr(2)), 1) AS p FROM d)),
    wk AS (SELECT w.*, k.id FROM w LEFT JOIN k ON k.s = {norm.format('w.s')}),
    l AS (SELECT r, pos, q AS line, s FROM (SELECT r, pos, unnest(string_split(s, chr(10))) AS s, generate_subscripts(string_split(s, chr(10)), 1) AS q FROM wk WHERE id IS NULL)),
    found AS (SELECT r, pos, 0 AS line, id FROM wk WHERE id IS NOT NULL UNION ALL SELECT r, pos, line, k.id FROM l JOIN k ON k.s = {norm.format('l.s')}),
    h AS (SELECT r, list(id ORDER BY pos, line) AS ids FROM found GROUP BY r),
    m(r, ord, name, want, ids, step) AS (
      SELECT r, ord, name, want, ids, 0 FROM h, ru
      UNION ALL SELECT r, ord, name, want, ids[list_position(ids, want[step + 1]) + 1:], step + 1 FROM m WHERE step < len(want) AND list_contains(ids, want[step + 1])),
    hit AS (SELECT DISTINCT r, ord, name FROM m WHERE step = len(want)),
    n AS (SELECT r, string_agg(name, ',' ORDER BY ord) AS licenses FROM hit GROUP BY r)
    SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(licenses, '') AS licenses
    FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)"""


ORACLE = {"op4_exact_dedup": EXACT, "op6_near_dedup": NEAR, "op8_quality_rules": RULES, "op9_chat": CHAT, "op10_licenses": _license_sql()}
