"""DuckDB SQL for the queries that SQL can express."""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = rf"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reached r JOIN both_ways e ON e.a = r.other),
lowest AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN lowest l USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""

QUALITY_RULES = r"""
WITH
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
hashed AS (
  SELECT *, list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) AS h FROM found),
grams AS (
  SELECT doc_id, unnest(list_concat(
    list_transform(h, lambda x: x % 16384),
    CASE WHEN len(h) < 2 THEN [] ELSE list_transform(range(1, len(h)), lambda i: (h[i] * 31 + h[i + 1] + 1) % 16384) END)) AS bucket
  FROM hashed),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
counted AS (
  SELECT b.bucket, count(g.bucket) AS raw, count(t.doc_id) AS good
  FROM range(16384) b(bucket) LEFT JOIN grams g ON g.bucket = b.bucket LEFT JOIN good t ON t.doc_id = g.doc_id GROUP BY 1),
sums AS (SELECT sum(good) AS goods, sum(raw) AS raws FROM counted),
weighed AS (
  SELECT bucket, CASE WHEN goods = 0 THEN 0
    ELSE round((ln((good + 0.5) / (goods + 8192.0)) - ln((raw + 0.5) / (raws + 8192.0))) * 1000000) END::BIGINT AS weight
  FROM counted, sums),
scored AS (SELECT doc_id, sum(weight)::DOUBLE / count(*) AS mean FROM grams JOIN weighed USING (bucket) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i,
    unnest(list_transform(range(1, len(w) - 6), lambda j: array_to_string(w[j:j + 7], ' '))) AS x
  FROM found WHERE len(w) >= 8),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(8) r(k) GROUP BY 1),
base AS (
  SELECT f.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM found f LEFT JOIN dup d USING (doc_id) LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT j.*, NOT base_failed AND coalesce(mean, 0) >= -100000 AS kept, floor(coalesce(mean, 0))::BIGINT AS weight
FROM judged j LEFT JOIN scored s USING (doc_id)
"""

DECONTAMINATE = r"""
WITH
doc AS (
  SELECT doc_id, regexp_extract_all(FOLD, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(FOLD, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wanted AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(
    range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + 9], ' '))) AS x
  FROM item WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM wanted),
windows AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i,
    unnest(list_transform(range(1, len(w) - n + 2), lambda j: array_to_string(w[j:j + n - 1], ' '))) AS x
  FROM doc, lengths WHERE len(w) >= n),
hits AS (SELECT doc_id, i, s.n, item_id FROM windows s JOIN wanted t ON s.n = t.n AND s.x = t.x),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM hits, range(10) r(k) WHERE k < hits.n GROUP BY 1),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM doc d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
""".replace("FOLD", _FOLD)

FILTER_AUDIT = r"""
WITH
texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
found AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper_n, min(doc_id) OVER (PARTITION BY text) AS first_id
  FROM texts),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * upper_n > 5 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM found LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM one a JOIN one b ON b.x <> a.x JOIN one c ON c.x NOT IN (a.x, b.x) JOIN one d ON d.x NOT IN (a.x, b.x, c.x)
  JOIN one e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS letter FROM orders, range(1, 6) r(step)),
met AS (
  SELECT s.*, c.*, contains(fails, letter) AS hit,
    length(translate(left(filter_order, step - 1), fails, '')) < step - 1 AS gone
  FROM steps s, cells c),
counted AS (
  SELECT part, filter_order, step, letter,
    sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed, sum(n) FILTER (hit AND gone) AS redundant,
    sum(n) FILTER (fails = letter) AS unique_fails, sum(good) FILTER (hit AND NOT gone) AS good_lost,
    sum(toxic) FILTER (hit AND NOT gone) AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM counted
"""

# A checksum is the exclusive or of what each byte adds at its distance from the end and of what the first state becomes.
SPELLING = r"""
WITH RECURSIVE
runs AS (
  SELECT doc_id::VARCHAR || ':' || run AS said, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(FOLD, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
letters AS (SELECT said, unnest(string_split(said, '')) AS x, generate_subscripts(string_split(said, ''), 1) AS i FROM runs),
bytes AS (
  SELECT said, 2 * i AS i, CASE WHEN ord(x) < 128 THEN ord(x) ELSE 195 END AS b FROM letters
  UNION ALL SELECT said, 2 * i + 1, ord(x) - 64 FROM letters WHERE ord(x) >= 128),
placed AS (
  SELECT said, b, row_number() OVER (PARTITION BY said ORDER BY i DESC) - 1 AS d, count(*) OVER (PARTITION BY said) AS n FROM bytes),
states(b, d, v) AS (
  SELECT b, 0, list_reduce(list_concat([b], range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
  FROM range(256) r(b)
  UNION ALL SELECT -1, 0, 4294967295::BIGINT
  UNION ALL
  SELECT b, d + 1, list_reduce(list_concat([v], range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
  FROM states WHERE d <= (SELECT max(n) FROM placed)),
sums AS (
  SELECT said, xor(xor(bit_xor(s.v), any_value(f.v)), 4294967295) AS h
  FROM placed p JOIN states s ON s.b = p.b AND s.d = p.d JOIN states f ON f.b = -1 AND f.d = p.n GROUP BY said),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c
    FROM runs JOIN sums USING (said))
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (
  SELECT word, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
met AS (
  SELECT c.word, w.word AS near FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT a.word, b.word FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word),
best AS (
  SELECT m.word, count(*) AS n_near, first(m.near ORDER BY w.n DESC, encode(m.near)) AS near, max(w.n) AS near_n
  FROM met m JOIN words w ON w.word = m.near GROUP BY m.word),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
ways(word, root) AS (
  SELECT word, coalesce(form, word) FROM forms
  UNION ALL SELECT y.word, f.form FROM ways y JOIN forms f ON f.word = y.root WHERE f.form IS NOT NULL AND f.word <> y.word),
ended AS (SELECT y.word, y.root FROM ways y JOIN forms f ON f.word = y.root WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ended e USING (word)
""".replace("FOLD", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
