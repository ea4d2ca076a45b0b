"""SQL for the queries of this subpackage that SQL can express."""

ORACLES = {
    "op7_chat": """
WITH opening AS (SELECT conv_id, min(turn) AS opening FROM conversations WHERE role = 'user' GROUP BY conv_id),
m AS (SELECT c.conv_id, c.turn, c.role, c.text, o.opening FROM conversations c LEFT JOIN opening o ON c.conv_id = o.conv_id)
SELECT m.conv_id, m.turn,
  CASE m.role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'tool' ELSE m.role END AS role,
  CASE m.role WHEN 'user' THEN concat('t', m.turn) WHEN 'assistant' THEN concat('t', m.turn - 1) END AS call_id,
  CASE WHEN m.role = 'user' THEN CASE WHEN m.turn > m.opening THEN 1 ELSE 0 END END AS depth,
  CASE WHEN m.role IN ('user', 'assistant') THEN p.conv_id IS NOT NULL END AS linked,
  CASE WHEN m.role = 'user' THEN TRUE END AS valid,
  CASE m.role
    WHEN 'user' THEN concat('{"role":"assistant","tool_call":{"arguments":',
      to_json(concat('{"question":', to_json(m.text), ',"turn":', m.turn, '}')), ',"id":"t', m.turn, '","name":"reply"}}')
    WHEN 'assistant' THEN concat('{"content":', to_json(m.text), ',"role":"tool","tool_call_id":"t', m.turn - 1, '"}')
    ELSE concat('{"content":', to_json(m.text), ',"role":', to_json(m.role), '}') END AS json,
  1 AS position
FROM m LEFT JOIN (SELECT DISTINCT conv_id, turn, role FROM conversations) p
  ON p.conv_id = m.conv_id
  AND ((m.role = 'user' AND p.role = 'assistant' AND p.turn = m.turn + 1)
    OR (m.role = 'assistant' AND p.role = 'user' AND p.turn = m.turn - 1))
""",
    "op11_fill_in_middle": """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', doc_id)) AS h FROM documents),
u AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM h),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
""",
    "op13_collocations": """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?' || chr(10) || chr(11) || chr(12) || chr(13) || chr(9), 'abcdefghijklmnopqrstuvwxyz......... '), '.')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS p, list_filter(string_split(piece, ' '), lambda x: x <> '') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
pairs AS MATERIALIZED (SELECT lang, p, i, w[i] AS x, w[i + 1] AS y FROM (SELECT lang, p, w, unnest(range(1, len(w))) AS i FROM w)),
f2 AS MATERIALIZED (SELECT lang, x, y, count(*) AS c FROM pairs GROUP BY lang, x, y HAVING count(*) >= 100),
o2 AS MATERIALIZED (SELECT lang, p, i, x || ' ' || y AS gram, y FROM pairs SEMI JOIN f2 USING (lang, x, y)),
o3 AS MATERIALIZED (SELECT a.lang, a.p, a.i, a.gram || ' ' || b.y AS gram FROM o2 a JOIN o2 b ON a.p = b.p AND a.i + 1 = b.i),
o4 AS MATERIALIZED (SELECT a.lang, a.p, a.i, a.gram || ' ' || b.y AS gram FROM o3 a JOIN o2 b ON a.p = b.p AND a.i + 2 = b.i),
o5 AS (SELECT a.lang, a.gram || ' ' || b.y AS gram FROM o4 a JOIN o2 b ON a.p = b.p AND a.i + 3 = b.i),
f AS MATERIALIZED (SELECT lang, x || ' ' || y AS gram, c, 2 AS size FROM f2
  UNION ALL SELECT lang, x, count(*), 1 FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY lang, x HAVING count(*) >= 100
  UNION ALL SELECT lang, gram, count(*), 3 FROM o3 GROUP BY lang, gram HAVING count(*) >= 100
  UNION ALL SELECT lang, gram, count(*), 4 FROM o4 GROUP BY lang, gram HAVING count(*) >= 100
  UNION ALL SELECT lang, gram, count(*), 5 FROM o5 GROUP BY lang, gram HAVING count(*) >= 100),
g AS (SELECT *, string_split(gram, ' ') AS ws FROM f),
onward AS (SELECT lang, gram, max(c) AS c FROM (
    SELECT lang, array_to_string(ws[1:size - 1], ' ') AS gram, c FROM g WHERE size > 2
    UNION ALL SELECT lang, array_to_string(ws[2:size], ' '), c FROM g WHERE size > 2) GROUP BY lang, gram),
held AS (SELECT g.* FROM g LEFT JOIN onward o ON g.lang = o.lang AND g.gram = o.gram WHERE g.size > 1 AND (o.c IS NULL OR o.c < g.c)),
cuts AS (SELECT lang, gram, c, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:size], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM held)),
scored AS (SELECT c.lang, c.gram, c.c AS a, n.n, k, l.c AS l, r.c AS r, (1000::HUGEINT * c.c * n.n) // (l.c::HUGEINT * r.c) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.gram = c.first JOIN f r ON r.lang = c.lang AND r.gram = c.rest JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram)::BIGINT AS rank, gram AS phrase,
  a, l, r, n, score::BIGINT AS score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) <= 2000
""",
}
