"""DuckDB SQL for the registered queries that SQL can express over whole tables."""

from __future__ import annotations

SQL = {
    "op3_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
""",
    "op5_chat_masks": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(10 + length(regexp_replace(role, '<(\\*)(/?s>|m>|\|endoftext\|>)', '<\1\\\2', 'g'))
    + length(regexp_replace(text, '<(\\*)(/?s>|m>|\|endoftext\|>)', '<\1\\\2', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
""",
    "op7_url_rules": r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT p.page_id, r.rule_host || r.rule_path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC) AS place
  FROM parts p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host))
    AND starts_with(p.path, r.rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.place = 1
""",
    "op10_decontamination": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM phrases),
spots AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)),
found AS (SELECT s.doc_id, s.i, s.k, p.item_id FROM spots s JOIN phrases p ON s.phrase = p.phrase AND s.k = p.k),
marked AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(m.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
  sha256(coalesce(n.items, '')) AS items_sha256, coalesce(m.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN marked m ON d.doc_id = m.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
""",
    "op11_turn_trie": r"""
WITH said AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS turns, CAST(xor(list_reduce(
    [4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b)] || range(8), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)),
    4294967295) % 4 AS INT) AS h
  FROM said GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, coalesce(d.turns[1:o.h], []) || o.turns[o.h + 1:] AS turns
  FROM own o LEFT JOIN own d ON d.conv_id = o.conv_id - (o.conv_id % 20 + 20) % 20),
steps AS (
  SELECT conv_id, d AS depth, turns[1:d] AS prefix, d = len(turns) AS ends, turns[1:d - 1] AS above
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(above) AS above,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(prefix[depth].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM steps GROUP BY prefix, depth),
kids AS (SELECT above, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(k.n, 0) AS n_children FROM nodes n
  LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.above LEFT JOIN kids k ON k.above = n.prefix),
sums AS (
  SELECT prefix[1:d] AS top, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT prefix, saved, n_children, unnest(range(0, depth + 1)) AS d FROM linked) GROUP BY top)
SELECT l.conv_id, l.depth, l.parent_conv_id, l.n_convs, l.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, l.ends_sha256
FROM linked l JOIN sums s ON s.top = l.prefix
""",
    "op12_spelling_groups": r"""
WITH RECURSIVE steps AS (
  SELECT list(list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS step
  FROM range(256) t(b)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents),
counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS head, run, count(*) AS n FROM runs GROUP BY ALL),
summed AS (
  SELECT run, n, xor(list_reduce([4294967295] || list_transform(
    regexp_extract_all(hex(encode(head)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
    lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM counted, steps),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word
    FROM summed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
spots AS (SELECT word, length(word) AS size, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT DISTINCT word, size, left(word, CAST(i - 1 AS INT)) || substr(word, CAST(i + 1 AS INT)) AS rest FROM spots),
swaps AS (SELECT word, i, left(word, CAST(i - 1 AS INT)) || '*' || substr(word, CAST(i + 1 AS INT)) AS shape FROM spots),
near AS (
  SELECT a.word, b.word AS other FROM swaps a JOIN swaps b ON a.shape = b.shape AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT h.word, w.word FROM holes h JOIN words w ON h.rest = w.word
  UNION ALL SELECT w.word, h.word FROM holes h JOIN words w ON h.rest = w.word),
best AS (
  SELECT p.word, count(*) AS n_near, first(p.other ORDER BY o.n DESC, p.other) AS other, max(o.n) AS m
  FROM near p JOIN words o ON p.other = o.word GROUP BY p.word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.other END AS form,
    CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
paths AS (
  SELECT word, word AS stop, 0 AS steps FROM formed
  UNION ALL SELECT p.word, f.form, p.steps + 1 FROM paths p JOIN formed f ON p.stop = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(stop, steps) AS root FROM paths GROUP BY word)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON f.word = e.word
""",
}
