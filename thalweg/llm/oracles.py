"""SQL for DuckDB that gives the rows of registered queries, from the same tables by other ways.

Shards: ranks within arcs, own rows by running counts, the surplus by a recursion over
the arcs that have one. Near duplicates: exact similarities of all pairs that share a
shingle, and a recursion over links. Contamination: a join of all windows of words.
"""

from __future__ import annotations

from thalweg.llm import decontamination, prefix_trie, sharding, spelling

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_CRC_TABLE = """bits AS (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits)"""


def _crc32(text: str) -> str:
    """The checksum of a text that isn't empty; t is the table's."""
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


SHARDING = f"""
WITH RECURSIVE
{_CRC_TABLE},
docs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {_crc32("text")} END AS text_crc32,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents, crc_table),
points AS (SELECT ('0x' || substr(md5(s || ':' || p), 1, 15))::BIGINT AS h, s FROM range({sharding.SHARDS}) a(s), range({sharding.POINTS}) b(p)),
nodes AS (SELECT h, s, row_number() OVER (ORDER BY h, s) - 1 AS arc FROM points),
placed AS (
  SELECT d.*, coalesce(n.arc, 0) AS arc FROM docs d ASOF LEFT JOIN nodes n ON d.h <= n.h),
ranked AS (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY h, doc_id, size, text_crc32) - 1 AS rank FROM placed),
total AS (SELECT count(*) AS n FROM docs),
room AS (SELECT s, n // {sharding.SHARDS} + (s < n % {sharding.SHARDS})::INT AS room FROM range({sharding.SHARDS}) a(s), total),
per_arc AS (SELECT arc, s, count(doc_id IS NULL OR doc_id IS NOT NULL) FILTER (size IS NOT NULL) AS n FROM nodes LEFT JOIN ranked USING (arc) GROUP BY arc, s),
own AS (
  SELECT *, greatest(0, least(n, room - before)) AS took FROM (
    SELECT arc, p.s, n, room, coalesce(sum(n) OVER (PARTITION BY p.s ORDER BY arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per_arc p JOIN room USING (s))),
spare AS (SELECT list(room - least(room, n) ORDER BY s) AS spare FROM (SELECT s, any_value(room) AS room, sum(n) AS n FROM own GROUP BY s)),
rooms AS (SELECT list(room ORDER BY s) AS rooms FROM room),
ring AS (SELECT list(s ORDER BY arc) AS shard_of FROM nodes),
over AS (SELECT list(arc ORDER BY arc) AS arcs, list(n - took ORDER BY arc) AS left_over, list(took ORDER BY arc) AS first FROM own WHERE n > took),
walk AS (
  SELECT 1 AS i, 0 AS step, 0::HUGEINT AS done, spare AS room, NULL::BIGINT AS arc, NULL::HUGEINT AS low, NULL::HUGEINT AS high, NULL::BIGINT AS s, NULL::HUGEINT AS slot FROM spare
  UNION ALL
  SELECT CASE WHEN done + k >= left_over[i] THEN i + 1 ELSE i END, CASE WHEN done + k >= left_over[i] THEN 0 ELSE step + 1 END, CASE WHEN done + k >= left_over[i] THEN 0 ELSE done + k END,
    list_transform(w.room, lambda x, j: CASE WHEN j = to_s + 1 THEN x - k ELSE x END), arcs[i], first[i] + done, first[i] + done + k, to_s, rooms[to_s + 1] - w.room[to_s + 1]
  FROM (SELECT w.*, to_s, least(left_over[i] - done, w.room[to_s + 1]) AS k, arcs, left_over, first FROM
    (SELECT w.*, shard_of[(arcs[i] + step + 1) % len(shard_of) + 1] AS to_s, arcs, left_over, first FROM walk w, over, ring WHERE i <= len(arcs)) w) w, rooms),
plan AS (
  SELECT arc, 0 AS low, took AS high, s, before AS slot FROM own WHERE took > 0
  UNION ALL SELECT arc, low, high, s, slot FROM walk WHERE high > low)
SELECT r.doc_id, r.size::BIGINT AS size, r.text_crc32::BIGINT AS text_crc32, 'rows' AS law, p.s::INT AS shard, (p.slot + r.rank - p.low)::BIGINT AS slot, NULL::INT AS grown_shard
FROM ranked r JOIN plan p ON r.arc = p.arc AND r.rank >= p.low AND r.rank < p.high
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE
split AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^ \\t\\n\\v\\f\\r]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes m ON m.doc_id = a JOIN sizes k ON k.doc_id = b
  WHERE 100 * shared >= 85 * (m.n + k.n - shared)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept
FROM documents JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

DECONTAMINATION = f"""
WITH
words AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT *, least({decontamination.WINDOW}, len(w)) AS n FROM items WHERE len(w) > 0),
sought AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
there AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS run
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, i, there.n FROM there JOIN sought ON there.n = sought.n AND there.run = sought.run),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS joined FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {decontamination.SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

PREFIX_TRIE = f"""
WITH
{_CRC_TABLE},
given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id AS c, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM given GROUP BY conv_id),
cut AS (SELECT c, turns, {_crc32("c::VARCHAR")} % {prefix_trie.HEADS} AS h FROM own, crc_table),
built AS (SELECT a.c, coalesce(b.turns[1 : h], []) || a.turns[h + 1 :] AS turns FROM cut a LEFT JOIN own b ON b.c = a.c - a.c % {prefix_trie.GROUP}),
members AS (SELECT c, d, turns[1 : d] AS path, d = len(turns) AS ends FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM built)),
nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n, coalesce(octet_length(encode(path[d].text)), 0) AS size, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY path, d),
children AS (SELECT path[1 : d - 1] AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
sized AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (path, d)),
folded AS (
  SELECT path[1 : up] AS path, up AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * size) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS up FROM sized) GROUP BY ALL)
SELECT s.conv_id, s.d::BIGINT AS depth, p.conv_id AS parent_conv_id, s.n AS n_convs, s.n_children, n_leaves, saved::BIGINT AS saved_tokens, s.ends_sha256
FROM sized s JOIN folded USING (path, d) LEFT JOIN nodes p ON s.d > 0 AND p.d = s.d - 1 AND p.path = s.path[1 : s.d - 1]
"""

SPELLING = f"""
WITH RECURSIVE
{_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("coalesce(doc_id::VARCHAR, 'null') || ':' || run")} AS h FROM counted, crc_table),
written AS (SELECT CASE WHEN h % {spelling.MISSPELT} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT x.word, y.word AS other, y.n FROM gaps x JOIN gaps y USING (i, a, b) WHERE x.word <> y.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON w.word = g.a || g.b
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON w.word = g.a || g.b),
best AS (SELECT word, count(*) AS n_near, min({{'less': -n, 'other': other}}) AS best FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= {spelling.FORM_SHARE} * w.n THEN best.other END AS form, CASE WHEN -best.less >= {spelling.FORM_SHARE} * w.n THEN -best.less END AS form_n FROM words w LEFT JOIN best USING (word)),
followed AS (SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT r.word, f.form, k + 1 FROM followed r JOIN forms f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM forms f JOIN (SELECT word, arg_max(root, k) AS root FROM followed GROUP BY word) r USING (word)
"""

SQL = {"op12_spelling": SPELLING, "op11_prefix_trie": PREFIX_TRIE, "op2_sharding": SHARDING, "op6_near_duplicates": NEAR_DUPLICATES, "op7_decontamination": DECONTAMINATION}
