"""DuckDB SQL of the queries that SQL expresses over whole tables."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, letters: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UP}', '{_LOW}'), '{letters}')"


_ALNUM, _SOLID = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"

OP5 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_words("text", _ALNUM)} AS w FROM documents),
items AS (SELECT DISTINCT item_id, {_words("text", _ALNUM)} AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, list_slice(w, s, s + 12) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM items WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
found AS MATERIALIZED (SELECT doc_id, s, n, item_id FROM places JOIN windows ON list_slice(w, s, s + n - 1) = win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
own AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""

OP7 = """
WITH lines AS MATERIALIZED (
  SELECT doc_id, no, l[no] AS line, list_sort(list_distinct(list_filter(string_split(lower(l[no]), ' '), lambda x: x <> ''))) AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM documents)
),
sets AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY f.doc_id, f.no) AS id, w, len(w) AS n, f
  FROM (SELECT w, min({'doc_id': doc_id, 'no': no}) AS f FROM lines WHERE len(w) > 0 GROUP BY w)
),
tokens AS (SELECT id, n, unnest(w) AS word FROM sets WHERE n >= 9),
ordered AS (
  SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY df, word) AS pos
  FROM (SELECT id, n, word, count(*) OVER (PARTITION BY word) AS df FROM tokens)
),
prefix AS MATERIALIZED (SELECT id, n, word FROM ordered WHERE pos <= n - CAST(ceil(n * 9 / 10) AS BIGINT) + 1),
pairs AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.word = b.word AND a.id > b.id
  AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 9
),
later AS (
  SELECT DISTINCT a AS id FROM (
    SELECT a, x.n + y.n AS total, len(list_intersect(x.w, y.w)) AS common FROM pairs JOIN sets x ON x.id = a JOIN sets y ON y.id = b
  ) WHERE 10 * common >= 9 * (total - common)
),
marked AS (
  SELECT l.doc_id, l.no, l.line, s.id IS NOT NULL AND ({'doc_id': l.doc_id, 'no': l.no} <> s.f OR later.id IS NOT NULL) AS gone
  FROM lines l LEFT JOIN sets s ON s.w = l.w LEFT JOIN later USING (id)
),
per AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_removed > 0 AND trim(replace(kept, chr(10), ' ')) = '', false) AS emptied, kept AS text
FROM documents d LEFT JOIN per USING (doc_id)
"""

OP8 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_words("text", _SOLID)} AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM d
),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS MATERIALIZED (SELECT doc_id, n, g FROM (SELECT *, count(*) OVER (PARTITION BY g) AS df FROM grams) WHERE df > 1),
links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, x.n + y.n AS total, count(*) AS common FROM shared x JOIN shared y ON x.g = y.g AND x.doc_id <> y.doc_id
    AND least(x.n, y.n) * 10 >= greatest(x.n, y.n) * 9 GROUP BY ALL
  ) WHERE 100 * common >= 90 * (total - common)
),
reach AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.c = l.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m.component_id
FROM sets s JOIN (SELECT id, min(c) AS component_id FROM reach GROUP BY id) m ON m.id = s.doc_id
"""

OP10 = r"""
WITH own AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM own),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length(text) + length(regexp_replace(text, '[^\\\[<]', '', 'g'))
    + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 12
      ELSE 16 + length(role) + length(regexp_replace(role, '[^\\\[<\]]', '', 'g')) END AS chars
  FROM turns
),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""

OP11 = f"""
WITH crc AS MATERIALIZED (
  SELECT list(list_reduce([i] || range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
),
runs AS MATERIALIZED (
  SELECT doc_id, w, count(*) AS c, hex(encode(concat(CAST(doc_id AS VARCHAR), ':', w))) AS x
  FROM (SELECT doc_id, unnest({_words("text", "[A-Za-z\u00C0-\u00FF]+")}) AS w FROM documents) GROUP BY doc_id, w
),
hashed AS MATERIALIZED (
  SELECT w, c, xor(4294967295, list_reduce(
    [4294967295] || list_transform(range(CAST(length(x) / 2 AS BIGINT)), lambda k: CAST(('0x' || substr(x, 2 * k + 1, 2)) AS BIGINT)),
    lambda s, b: xor(s >> 8, t[xor(s & 255, b) + 1]))) AS h
  FROM runs, crc
),
edited AS (
  SELECT CASE WHEN h % 97 = 0 THEN concat(substr(w, 1, h % length(w)), substr(w, h % length(w) + 2)) ELSE w END AS word, c FROM hashed
),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
holes AS MATERIALIZED (
  SELECT word, n, length(word) AS size, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word
),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, list(other ORDER BY m DESC, other)[1] AS other FROM near GROUP BY word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
),
ways(word, goes) AS (
  SELECT word, word FROM formed
  UNION ALL SELECT ways.word, f.form FROM ways JOIN formed f ON ways.goes = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, e.goes AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT ways.word, ways.goes FROM ways JOIN formed g ON ways.goes = g.word WHERE g.form IS NULL) e ON f.word = e.word
""".replace("WITH crc", "WITH RECURSIVE crc")

OP12 = f"""
WITH pieces AS MATERIALIZED (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)
),
grams AS MATERIALIZED (
  SELECT lang, size, list_slice(w, i, i + size - 1) AS g, count(*) AS f
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size)
  GROUP BY lang, size, g
),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT * FROM grams WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.size, c.g, c.f AS a, k, x.f AS l, y.f AS r,
    CAST((1000000 * CAST(c.f AS HUGEINT) * c.f) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN grams x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, k) JOIN grams y ON y.lang = c.lang AND y.g = list_slice(c.g, k + 1, c.size)
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (SELECT lang, unnest([list_slice(g, 1, 2), list_slice(g, 2, 3)]) AS g, f FROM candidates WHERE size = 3),
longer AS (SELECT lang, g, max(f) AS most FROM inner_ GROUP BY lang, g),
left_ AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM best b LEFT JOIN longer o ON b.lang = o.lang AND b.g = o.g
  WHERE most IS NULL OR 100 * most < 50 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM left_ JOIN totals USING (lang) QUALIFY rank <= 2000
"""

OP13 = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY doc_id)
"""

ORACLES = {
    "op5_decontaminate": OP5, "op7_line_dedup": OP7, "op8_ngram_join": OP8, "op10_chat_format": OP10, "op11_spelling_variants": OP11,
    "op12_collocations": OP12, "op13_exact_dedup": OP13,
}
