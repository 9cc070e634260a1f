"""Check SQL that takes a recursion: turn repair and spelling groups."""

# crc32 by its rule: 256 remainders of the reflected polynomial, then one table look-up for each byte
_CRC_TABLE = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"""


def _crc32(hexed: str) -> str:
    """Of a column of hexadecimal bytes; ``tab`` is in scope."""
    numbers = f"list_transform(range(1, length({hexed}), 2), lambda p: CAST('0x' || substr({hexed}, p, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {numbers}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


_TURN = "CASE q WHEN 'u' THEN 'a' ELSE 'u' END"

TURN_REPAIR = f"""
WITH RECURSIVE {_CRC_TABLE},
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS x FROM conversations),
k AS (SELECT conv_id, turn, role, text, {_crc32('x')} % 20 AS kind FROM h, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT conv_id, turn, role, text, left(role, 1) AS init, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS ending,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS time FROM d),
f AS (SELECT conv_id, turn, role, text, init, i, CASE WHEN ending = '' THEN 'blank' WHEN time > 1 THEN 'duplicate'
    WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(init) OVER (PARTITION BY conv_id ORDER BY i) || init NOT IN ('su', 'ua', 'au') AS illegal FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
  count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE illegal) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
s(conv_id, i, q, b) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 'n', {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''}} FROM conversations
  UNION ALL
  SELECT conv_id, i + 1, e.q, min({{'cost': CAST(b.cost + ins.cost + e.cost AS BIGINT), 'audit': b.audit || ins.audit || e.audit, 'lines': b.lines || ins.lines || e.lines}})
  FROM (SELECT conv_id, i, b, ins, unnest(list_filter([
      {{'q': q, 'cost': 2, 'audit': 'D', 'lines': '', 'ok': true}},
      {{'q': init, 'cost': 0 + late, 'audit': 'K', 'lines': role || ':' || text || chr(10), 'ok': stays AND q || init IN ('ns', 'nu', 'su', 'ua', 'au')}},
      {{'q': {_TURN}, 'cost': 1 + late, 'audit': 'R', 'lines': CASE {_TURN} WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text || chr(10), 'ok': stays}}
    ], lambda z: z.ok)) AS e
    FROM (SELECT *, ins.q AS q, fault NOT IN ('blank', 'duplicate') AS stays, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS late
      FROM (SELECT s.conv_id, s.i, s.b, f.init, f.role, f.text, f.fault, unnest([{{'q': s.q, 'cost': 0, 'audit': '', 'lines': ''}},
          {{'q': {_TURN.replace('q ', 's.q ', 1)}, 'cost': 5, 'audit': 'I', 'lines': CASE s.q WHEN 'u' THEN 'assistant:' ELSE 'user:' END || chr(10)}}]) AS ins
        FROM s JOIN f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = s.i + 1)))
  GROUP BY ALL),
z AS (SELECT s.conv_id, min(CASE WHEN q = 'u' THEN {{'cost': b.cost + 5, 'audit': b.audit || 'I', 'lines': b.lines || 'assistant:' || chr(10)}} ELSE b END) AS b
  FROM s LEFT JOIN c ON s.conv_id IS NOT DISTINCT FROM c.conv_id WHERE s.i = coalesce(c.n, 0) AND q IN ('n', 'a', 'u') GROUP BY s.conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, b.cost AS cost, b.audit AS audit, sha256(left(b.lines, greatest(length(b.lines) - 1, 0))) AS repaired_sha256
FROM z LEFT JOIN c ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""

SPELLING_GROUPS = f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
u AS (SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM r GROUP BY ALL HAVING length(run) >= 6),
x AS (SELECT run, k, hex(encode(doc || ':' || run)) AS x FROM u),
h AS (SELECT run, k, {_crc32('x')} AS h FROM x, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n
  FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(k) >= 5),
p AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS z FROM w, unnest(range(1, length(word) + 1)) AS g(i)),
near AS (SELECT l.word, m.word AS other, m.n AS other_n FROM p l JOIN p m ON l.i = m.i AND l.a = m.a AND l.z = m.z AND l.word <> m.word
  UNION SELECT l.word, m.word, m.n FROM p l JOIN w m ON l.a || l.z = m.word
  UNION SELECT m.word, l.word, l.n FROM p l JOIN w m ON l.a || l.z = m.word),
b AS (SELECT word, count(*) AS n_near, min({{'less': -other_n, 'other': other}}) AS best FROM near GROUP BY word),
t AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * n THEN best.other END AS form, CASE WHEN -best.less >= 5 * n THEN -best.less END AS form_n
  FROM w LEFT JOIN b USING (word)),
c(word, root, on_to) AS (SELECT word, word, form FROM t UNION ALL SELECT c.word, t.word, t.form FROM c JOIN t ON t.word = c.on_to)
SELECT t.word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM t JOIN c ON c.word = t.word AND c.on_to IS NULL
"""
