"""DuckDB SQL for the queries that SQL can state, over the same tables."""

_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(coalesce(text, ''), '{_ABC}', '{_ABC.lower()}')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
seen AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN seen USING (k) WHERE d < doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT word.doc_id, count(hit.p) AS n, string_agg(x, ' ' ORDER BY word.p) FILTER (hit.p IS NULL) AS t
  FROM word LEFT JOIN hit ON hit.doc_id = word.doc_id AND hit.p = word.p GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

OP3 = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
place AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM b),
win AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 200) AS k FROM place),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 100)) AS p FROM ranked WHERE r > 1),
byte AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM b),
flag AS (SELECT byte.doc_id, byte.p, substr(h, CAST(2 * byte.p + 1 AS BIGINT), 2) AS x, hit.p IS NOT NULL AS gone
  FROM byte LEFT JOIN hit ON hit.doc_id = byte.doc_id AND hit.p = byte.p),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM flag),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n, count(*) FILTER (opens) AS s, string_agg(x, '' ORDER BY p) FILTER (NOT gone) AS t FROM edge GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(s, 0) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM b LEFT JOIN kept USING (doc_id)"""

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, CASE WHEN len(ws) >= 3 THEN len(ws) - 1 WHEN len(ws) > 0 THEN 2 ELSE 1 END)) AS i FROM w)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN size s ON s.doc_id = x JOIN size t ON t.doc_id = y WHERE 100 * c >= 85 * (s.n + t.n - c)),
arc AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, arc.y FROM reach JOIN arc ON arc.x = reach.y),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN size USING (doc_id)"""

OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b
  ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

OP8 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw))),
found AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON bw.n = dw.n AND bw.k = dw.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS h FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS c, string_agg(x, ',' ORDER BY x) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(h, 0) AS n_hit, coalesce(c, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(h, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

_CODES = "[CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END FOR c IN string_split({0}, '')]"
_CRC = f"""list_reduce(flatten({_CODES}), lambda h, x: xor(h >> 8, tab[1 + (xor(h, CAST(x AS BIGINT)) & 255)]), CAST(4294967295 AS BIGINT))"""

OP11 = f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1
    THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, CAST(i AS BIGINT)) AS v FROM range(256) t(i))),
run AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents) GROUP BY 1, 2),
h AS (SELECT w, n, xor({_CRC.format("concat(doc_id, ':', w)")}, 4294967295) AS h FROM run, crc WHERE len(w) >= 5),
word AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0
    THEN concat(substr(w, 1, CAST(h % len(w) AS BIGINT)), substr(w, CAST(h % len(w) + 2 AS BIGINT))) ELSE w END AS w FROM h)
  WHERE len(w) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cut AS (SELECT w, i, concat(substr(w, 1, i - 1), substr(w, i + 1)) AS s FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM word)),
near AS (SELECT a.w, b.w AS v FROM cut a JOIN cut b ON a.i = b.i AND a.s = b.s AND a.w <> b.w
  UNION SELECT cut.w, s FROM cut JOIN word ON word.w = s UNION SELECT s, cut.w FROM cut JOIN word ON word.w = s),
best AS (SELECT near.w, v, word.n AS m, row_number() OVER (PARTITION BY near.w ORDER BY word.n DESC, v) AS r, count(*) OVER (PARTITION BY near.w) AS c
  FROM near JOIN word ON word.w = v),
formed AS (SELECT word.w, word.n, coalesce(c, 0) AS c, CASE WHEN m >= 2 * word.n THEN v END AS v, CASE WHEN m >= 2 * word.n THEN m END AS m
  FROM word LEFT JOIN best ON best.w = word.w AND r = 1),
path AS (SELECT w, w AS x, 0 AS d FROM formed UNION ALL SELECT path.w, v, d + 1 FROM path JOIN formed ON formed.w = path.x WHERE v IS NOT NULL)
SELECT formed.w AS word, v AS form, (SELECT max_by(x, d) FROM path WHERE path.w = formed.w) AS root, n, c AS n_near, m AS form_n FROM formed"""

OP12 = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws
  FROM (SELECT lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY 1),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM p, range(1, 6) t(k) WHERE len(ws) >= k) GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.k, c.phrase, c.a, j, x.a AS l, y.a AS r, n, CAST(1000 AS HUGEINT) * c.a * n // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN total USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS b FROM cut),
kept AS (SELECT * FROM best WHERE b = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.lang = best.lang AND c.k > best.k AND 100 * c.a >= 100 * best.a
  AND contains(concat(' ', c.phrase, ' '), concat(' ', best.phrase, ' ')))),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000"""
