"""SQL that gives the rows of the registered queries independently, where SQL can express them."""

MIX = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17|' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         2.0::DOUBLE * source_size AS lim FROM totals),
levels AS (
  SELECT a.lim / a.w AS r,
         ((SELECT 1.5::DOUBLE * sum(source_size) FROM weighed)
           - coalesce((SELECT sum(lim) FROM weighed b WHERE b.lim / b.w < a.lim / a.w), 0.0))
         / (SELECT sum(w) FROM weighed b WHERE b.lim / b.w >= a.lim / a.w) AS level
  FROM weighed a),
chosen AS (SELECT level FROM levels WHERE level < r ORDER BY r LIMIT 1),
sources AS (
  SELECT source, source_size, least(lim, w * coalesce((SELECT level FROM chosen), 0.0))::DOUBLE AS target FROM weighed),
budgets AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM sources),
ordered AS (
  SELECT doc_id, source, size, source_size, target, budget, epochs,
         sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM sized JOIN budgets USING (source)
  UNION ALL
  SELECT doc_id, s.source, size, source_size, target, budget, epochs,
         sum(size) OVER (ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size
  FROM sized s JOIN budgets b ON s.source IS NULL AND b.source IS NULL)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM ordered
"""

DECONTAMINATE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT DISTINCT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[p : p + size - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM (SELECT *, least(13, len(w)) AS size FROM item WHERE len(w) > 0))),
places AS (
  SELECT k, p, size, array_to_string(w[p : p + size - 1], ' ') AS win
  FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS p
        FROM doc, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT k, p, size, item_id FROM places JOIN windows USING (size, win)),
hit AS (SELECT k, count(DISTINCT i) AS n_hit FROM (SELECT k, unnest(range(p, p + size)) AS i FROM (SELECT DISTINCT k, p, size FROM found)) GROUP BY k),
owners AS (
  SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT k, coalesce(item_id::VARCHAR, '') AS item FROM found) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (k) LEFT JOIN owners USING (k)
"""

LINE_DEDUP = r"""
WITH doc AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
raw AS (
  SELECT doc_id, p, parts[p] AS line,
         regexp_replace(parts[p], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body,
         len(regexp_extract_all(parts[p], '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS p FROM doc)),
line AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i,
         sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS e
  FROM raw WHERE w > 0),
win AS (
  SELECT a.doc_id, a.i AS f, min(b.i) AS l FROM line a JOIN line b
    ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49 AND b.e - a.e + a.w >= 50 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.i) AS f, b.i AS l FROM line a JOIN line b
    ON a.doc_id = b.doc_id AND a.i BETWEEN b.i - 49 AND b.i AND b.e - a.e + a.w >= 50 GROUP BY b.doc_id, b.i),
content AS (
  SELECT win.doc_id, f, l, string_agg(body, chr(10) ORDER BY i) AS body
  FROM win JOIN line ON line.doc_id = win.doc_id AND i BETWEEN f AND l GROUP BY ALL),
origin AS (SELECT body, min((doc_id, f, l)) AS o FROM content GROUP BY body),
gone AS (
  SELECT DISTINCT c.doc_id, unnest(range(f, l + 1)) AS i FROM content c JOIN origin USING (body)
  WHERE c.doc_id <> o[1] OR f > o[3]),
kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.p) AS text
  FROM raw r LEFT JOIN line USING (doc_id, p) LEFT JOIN gone ON gone.doc_id = r.doc_id AND gone.i = line.i
  WHERE gone.i IS NULL GROUP BY r.doc_id)
SELECT doc.doc_id, coalesce(n, 0)::INT AS n_removed, CASE WHEN doc.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM doc LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) USING (doc_id)
"""

WARC = r"""
WITH page AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
judged AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS last_id
  FROM page)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last_id THEN last_id END AS refers_to
FROM judged
"""

URLS = (
    r"""
WITH RECURSIVE parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(rule, name, start, says) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
         ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
row_no AS (SELECT *, row_number() OVER () AS k FROM parsed),
fit AS (
  SELECT k, arg_max(rule, len(rule)) AS rule, arg_max(says, len(rule)) AS says FROM row_no JOIN rules
    ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY k),
row AS (
  SELECT row_no.*, rule, says,
         list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE
           WHEN regexp_matches(s, '^[0-9]+$') THEN '{n}'
           WHEN regexp_matches(s, '^[0-9]+\.[a-z]+$') THEN regexp_replace(s, '^[0-9]+', '{n}')
           WHEN regexp_matches(s, '[0-9]') THEN '{x}' WHEN len(s) > 24 THEN '{long}' ELSE s END) AS segments
  FROM row_no LEFT JOIN fit USING (k)),
tree0 AS (
  SELECT host, segments, segments AS t, count(*) AS n, count(*) FILTER (says = 'allow') AS a, count(*) FILTER (says = 'block') AS b
  FROM row GROUP BY ALL),
"""
    + r"""
deepest AS (SELECT max(len(t)) AS depth FROM tree0),
down AS (
  SELECT 0 AS k, host, segments, t, n, a, b FROM tree0
  UNION ALL
  SELECT k + 1, host, segments, CASE WHEN c > 16 AND most < 0.5 * whole THEN list_concat(list_concat(t[1:k], ['*']), t[k + 2:]) ELSE t END, n, a, b
  FROM (
    SELECT *, CASE WHEN len(t) > k THEN count(DISTINCT t[k + 1]) OVER p END AS c, max(n_child) OVER p AS most, sum(n) OVER p AS whole
    FROM (SELECT *, sum(n) OVER (PARTITION BY host, len(t) > k, t[1:k], t[k + 1]) AS n_child FROM down WHERE k < (SELECT depth FROM deepest))
    WINDOW p AS (PARTITION BY host, len(t) > k, t[1:k]))),
up AS (
  SELECT k, host, segments, t, n, a, b FROM down WHERE k = (SELECT depth FROM deepest)
  UNION ALL
  SELECT k - 1, host, segments,
         CASE WHEN len(t) >= k AND (k = 1 OR (c > 1 AND n_rests > 1)) AND n_all * q / n_child - n_child <= n_rests - 1 + 2 * sqrt(2.0::DOUBLE * (n_rests - 1))
           THEN list_concat(list_concat(t[1:k - 1], ['*']), t[k + 1:]) ELSE t END, n, a, b
  FROM (
    SELECT *, sum(n * n_cell / n_rest::DOUBLE) OVER (PARTITION BY host, len(t) >= k, t[1:k - 1], t[k]) AS q
    FROM (
      SELECT *, sum(n) OVER p AS n_all, sum(n) OVER (PARTITION BY host, len(t) >= k, t[1:k - 1], t[k]) AS n_child,
             sum(n) OVER (PARTITION BY host, len(t) >= k, t[1:k - 1], t[k + 1:]) AS n_rest,
             sum(n) OVER (PARTITION BY host, len(t) >= k, t[1:k - 1], t[k], t[k + 1:]) AS n_cell,
             count(DISTINCT t[k]) OVER p AS c, count(DISTINCT t[k + 1:]) OVER p AS n_rests
      FROM up WHERE k > 0 WINDOW p AS (PARTITION BY host, len(t) >= k, t[1:k - 1])))),
final AS (SELECT host, segments, a, b, CASE WHEN len(t) > 0 THEN t ELSE [''] END AS template FROM up WHERE k = 0),
top AS (SELECT (sum(b) + 1.0::DOUBLE) / (sum(a) + sum(b) + 2.0::DOUBLE) AS share FROM final),
hosts AS (SELECT host, (sum(b) + 4.0::DOUBLE * (SELECT share FROM top)) / (sum(a) + sum(b) + 4.0::DOUBLE) AS above FROM final GROUP BY host),
pure AS (
  SELECT host, template, (sum(b) + 4.0::DOUBLE * any_value(above)) / (sum(a) + sum(b) + 4.0::DOUBLE) AS blocked
  FROM final JOIN hosts USING (host) GROUP BY ALL)
SELECT page_id, row.host, path, rule, coalesce(says, CASE WHEN blocked > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM row JOIN final ON row.host = final.host AND row.segments = final.segments
JOIN pure ON pure.host = final.host AND pure.template = final.template
"""
)

TRIE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(len(role) || ':' || role || text)) AS pos FROM turns),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, (r & 1) * 3988292384::UBIGINT))),
           4294967295::UBIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM placed)),
rebuilt AS (
  SELECT c.conv_id, 0 AS side, p.pos, role, text FROM convs c JOIN placed p ON p.conv_id = c.base AND p.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, p.pos, role, text FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.pos > c.h),
step AS (
  SELECT conv_id, text, row_number() OVER w AS depth, list(struct_pack(role, text)) OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY side, pos ROWS UNBOUNDED PRECEDING)),
member AS (
  SELECT conv_id, depth, path, path[1 : depth - 1] AS above, len(text) AS chars FROM step
  UNION ALL SELECT conv_id, 0, [], NULL, 0 FROM convs),
last AS (SELECT conv_id, max(depth) AS depth FROM member GROUP BY conv_id),
node AS (
  SELECT depth, path, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = last_depth), '')) AS ends_sha256
  FROM member JOIN (SELECT conv_id, depth AS last_depth FROM last) USING (conv_id) GROUP BY depth, path),
children AS (SELECT above AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY above),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN children USING (path)),
total AS (
  SELECT m.path, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM full_node n JOIN member m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens,
       n.ends_sha256
FROM full_node n JOIN total USING (path) LEFT JOIN node p ON n.depth > 0 AND p.path = n.above
"""

SQL = {"op13_conversations": TRIE, "op8_urls": URLS, "op9_warc": WARC, "op6_line_dedup": LINE_DEDUP, "op3_decontaminate": DECONTAMINATE, "op5_mix": MIX}
