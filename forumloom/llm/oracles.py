"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

OP3 = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT doc_id, i, hash(array_to_string(w[i:i+12], ' ')) AS h, md5(array_to_string(w[i:i+12], ' ')) AS m
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)),
firsts AS (SELECT h, m, min(doc_id) AS f FROM windows GROUP BY h, m),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM windows JOIN firsts USING (h, m) WHERE f < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""

OP4 = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
reach AS (
  SELECT vec_id AS id, vec_id AS root FROM embeddings
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, root AS component_id, vec_id = root AS kept
FROM embeddings JOIN roots ON vec_id = id LEFT JOIN counts ON a = vec_id"""

OP5 = """
WITH rows_ AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
best AS (SELECT html, max(page_id) AS top FROM rows_ GROUP BY html),
hexed AS (SELECT page_id, html, top, sha1(html) AS h FROM rows_ JOIN best USING (html))
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h || '00', (i * 5) // 4 + 1, 3) AS INTEGER) >> (7 - (i * 5) % 4)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM hexed"""

OP6 = r"""
WITH lowered AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wanted AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wanted),
found AS (
  SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lowered, sizes)),
hits AS (SELECT doc_id, i, n, item_id FROM found JOIN wanted USING (n, k)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN covered USING (doc_id) LEFT JOIN owners USING (doc_id)"""

OP7 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM both_ JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * both_.n >= 75 * (x.n + y.n - both_.n)),
reach AS (
  SELECT doc_id AS id, doc_id AS root FROM documents
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, d.doc_id = root AS kept
FROM documents d JOIN roots ON d.doc_id = id LEFT JOIN sizes USING (doc_id)"""

OP8 = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split_ AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
judged AS (
  SELECT *, '.' || host AS h,
    CASE WHEN h LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
         WHEN h LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
         WHEN h LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
         WHEN h LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
         WHEN h LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM split_),
spam AS (
  SELECT DISTINCT host || regexp_replace(path, '/+$', '') AS u FROM split_
  WHERE regexp_matches(host, '^(?:[^.]+\.)*spam-farm\.'))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN host || regexp_replace(path, '/+$', '') IN (SELECT u FROM spam) THEN 'block' ELSE 'allow' END AS verdict
FROM judged"""

OP11 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + regexp_count_(text) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 WHEN 'system' THEN 19
    ELSE 23 + length(role) + regexp_count_(role) END AS n FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""
for _column in ("text", "role"):
    OP11 = OP11.replace(
        f"regexp_count_({_column})",
        rf"len(regexp_extract_all({_column}, '[<\[]\x{{2060}}*(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|role\|>|\|text\|>|\|end\|>)'))",
    )

OP12 = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT r, doc_id, len(w) AS n FROM words WHERE len(w) > 0),
size AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM docs),
cells AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM words) GROUP BY r, t),
wanted AS (
  SELECT DISTINCT i, item_id, t FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)),
weights AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM cells GROUP BY t), size),
scores AS (
  SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l)))) AS BIGINT) AS score
  FROM wanted JOIN cells USING (t) JOIN weights USING (t) JOIN docs USING (r), size GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 50"""

OP13 = """
WITH placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p,
    md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS b
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM placed GROUP BY conv_id),
heads AS (SELECT conv_id, conv_id - conv_id % 5 AS base, h FROM (SELECT conv_id, heads_(conv_id) AS h FROM sizes)),
turns AS (
  SELECT c.conv_id, p.p, 0 AS own, k, b FROM heads c JOIN placed p ON p.conv_id = c.base WHERE p.p < c.h
  UNION ALL SELECT c.conv_id, p.p, 1, k, b FROM heads c JOIN placed p ON p.conv_id = c.conv_id WHERE p.p >= c.h),
path AS (
  SELECT conv_id, row_number() OVER w AS d, b, md5(string_agg(k, '') OVER w) AS node FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY own, p)
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM heads),
lens AS (SELECT conv_id, max(d) AS n FROM path GROUP BY conv_id),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(b) AS b FROM path GROUP BY node, d),
up AS (
  SELECT x.node, y.node AS above FROM nodes x JOIN path y ON y.conv_id = x.conv_id AND y.d = x.d - 1),
kids AS (SELECT above AS node, count(*) AS n FROM up GROUP BY above),
closed AS (SELECT x.node, y.node AS above FROM nodes x JOIN path y ON y.conv_id = x.conv_id AND y.d <= x.d),
sums AS (
  SELECT above AS node, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n_convs - 1) * b) AS saved
  FROM closed JOIN nodes USING (node) LEFT JOIN kids USING (node) GROUP BY above),
ends AS (
  SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM path JOIN lens USING (conv_id) WHERE d = n GROUP BY node)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(kids.n, 0) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes x LEFT JOIN up USING (node) LEFT JOIN nodes p ON p.node = up.above LEFT JOIN kids ON kids.node = x.node
JOIN sums ON sums.node = x.node LEFT JOIN ends ON ends.node = x.node"""
# DuckDB has no CRC-32: the polynomial division, bit by bit over the digits
OP13 = OP13.replace(
    "heads_(conv_id)",
    "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), "
    "lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]"
    "::BIGINT[]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 9",
)

ORACLES = {
    "op3_substring_dedup": OP3,
    "op4_near_vectors": OP4,
    "op5_warc_archive": OP5,
    "op6_decontaminate": OP6,
    "op7_near_duplicates": OP7,
    "op8_filter_urls": OP8,
    "op11_chat_format": OP11,
    "op12_ranked_search": OP12,
    "op13_prefix_trie": OP13,
}
