"""DuckDB statements with the results of the registered queries, where SQL can express them."""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ESC = "replace(replace(replace({0}, '\\', '\\b'), '#', '\\h'), '<', '\\l')"

ORACLE = {
    "op8_chat_formatting": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, x, r, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(x, r)),
n AS (
  SELECT *, lag(role) OVER w AS prev, lead(role) OVER w AS next, row_number() OVER w AS i
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length({_ESC.format('text')})
        + CASE WHEN prev IS DISTINCT FROM role THEN 6 + length(replace({_ESC.format('role')}, ':', '\\c')) ELSE 7 END
        + CASE WHEN next IS DISTINCT FROM role THEN 8 ELSE 0 END) AS formatted_chars
  FROM n GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g""",
    "op9_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_FOLD} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op12_phrase_collocations": f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, {_FOLD} AS t FROM documents),
p AS (SELECT doc, lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece,
  generate_subscripts(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]'), 1) AS no FROM d),
w AS (SELECT doc, lang, no, unnest(regexp_extract_all(piece, '[^\\x20\\x09]+')) AS w,
  generate_subscripts(regexp_extract_all(piece, '[^\\x20\\x09]+'), 1) AS i FROM p),
g AS (SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
  FROM w WINDOW o AS (PARTITION BY doc, no ORDER BY i)),
f AS (
  SELECT lang, [w1] AS ws, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2], count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
k AS (SELECT lang, ws, f, unnest(range(1, len(ws))) AS k FROM f WHERE len(ws) > 1),
c AS (SELECT k.lang, k.ws, k.f AS a, k.k, l.f AS l, r.f AS r,
    CAST((2000000::HUGEINT * k.f) // (l.f + r.f) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.ws = k.ws[1:k.k] JOIN f r ON r.lang = k.lang AND r.ws = k.ws[k.k+1:]),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
s AS (SELECT lang, ws[i:i+m-1] AS ws, max(f) AS longer FROM f, range(2, 4) x(m), range(1, 4) y(i)
  WHERE len(ws) > m AND i + m - 1 <= len(ws) GROUP BY ALL),
z AS (SELECT b.*, array_to_string(b.ws, ' ') AS phrase FROM b LEFT JOIN s ON s.lang = b.lang AND s.ws = b.ws
  WHERE s.longer IS NULL OR 100::HUGEINT * s.longer < 80::HUGEINT * b.a)
SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score
FROM z JOIN (SELECT lang, count(*) AS n FROM w GROUP BY lang) t ON t.lang = z.lang
QUALIFY rank <= 2000""",
}
