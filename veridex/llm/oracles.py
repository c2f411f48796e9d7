"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def repeats(width: int) -> str:
    """Words in windows of ``width`` words that start more than once in all documents."""
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {width - 1}], ' ') AS k FROM w, unnest(range(1, len(ws) - {width - 2})) t(i)),
r AS (SELECT k FROM g GROUP BY k HAVING count(*) > 1),
p AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, i FROM g SEMI JOIN r USING (k)), range({width}) x(j)),
k AS (SELECT doc_id, pos, ws[pos] AS word FROM w, unnest(range(1, len(ws) + 1)) t(pos)),
s AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.pos) AS kept, count(*) AS n FROM k ANTI JOIN p USING (doc_id, pos) GROUP BY ALL)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(s.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)"""


OP3 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM d, unnest(range(1, len(ws) - 3)) t(i)),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM c, range(5) x(j) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORDS}') GROUP BY doc_id),
m AS (SELECT doc_id, source, len(ws) AS n_words, coalesce(CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT), 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (base_failed) AS failed, count(*) FILTER (base_failed) / CAST(count(*) AS DOUBLE) AS rate FROM b GROUP BY source),
q AS (SELECT avg(rate) AS m, var_samp(rate) AS v, sum(failed) / CAST(sum(docs) AS DOUBLE) AS overall FROM h),
p AS (SELECT CASE WHEN v > 0 AND v < m * (1 - m) THEN m ELSE overall END AS mean, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 10.0 END AS weight FROM q),
bad AS (SELECT source FROM h, p WHERE (failed + mean * weight) / (docs + weight) > 0.8)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM b.source) AS kept FROM b"""

OP7 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS k FROM w, unnest(range(1, len(ws) - 1)) t(i) UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM reach r JOIN s ON s.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m.least, w.doc_id)) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

_KEYS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP9 = rf"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_KEYS}') AS ws FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_KEYS}') AS ws FROM documents),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS k FROM b, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) t(i) WHERE len(ws) > 0),
dw AS (SELECT doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') AS k FROM d, (SELECT DISTINCT m FROM bw), unnest(range(1, len(ws) - m + 2)) t(i)),
h AS (SELECT DISTINCT doc_id, i, m, item_id FROM dw JOIN bw USING (m, k)),
n AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, m FROM h), range(13) x(j) WHERE j < m GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)"""

OP11 = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORDS}') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, {{'A': len(ws) < 50, 'B': 100 * list_unique(ws) < 65 * len(ws), 'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
  'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)}} AS fails FROM w LEFT JOIN l USING (doc_id)),
x AS (SELECT part, good, bad, list_filter(['A', 'B', 'C', 'D', 'E'], lambda c: CASE c WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END) AS failed FROM f),
n AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM x GROUP BY ALL),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM c a, c b, c d, c e, c g WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, string_split(substr(filter_order, 1, step - 1), '') AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (NOT list_has_any(failed, list_append(before, own))) AS kept, sum(n) FILTER (list_contains(failed, own) AND NOT list_has_any(failed, before)) AS removed,
  sum(n) FILTER (list_contains(failed, own) AND list_has_any(failed, before)) AS redundant, sum(n) FILTER (failed = [own]) AS unique_fails,
  sum(good) FILTER (list_contains(failed, own) AND NOT list_has_any(failed, before)) AS good_lost, sum(bad) FILTER (list_contains(failed, own) AND NOT list_has_any(failed, before)) AS toxic_lost FROM n, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
  coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS shapley FROM r"""

# crc32 with its table of 256 remainders
_TABLE = "SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc"
_BYTES = "list_transform(range(octet_length(encode(s))::BIGINT), lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::BIGINT)"
_CRC = f"xor(list_reduce(list_concat([4294967295::BIGINT], {_BYTES}), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
OP12 = rf"""
WITH RECURSIVE tab AS ({_TABLE}),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
k AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, {_CRC} AS h FROM k, tab),
d AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
g AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM d, unnest(range(1, length(word) + 1)) t(i)),
e AS (SELECT DISTINCT a.word AS a, b.word AS b FROM g a JOIN g b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT DISTINCT g.word, d.word FROM g JOIN d ON g.rest = d.word UNION SELECT DISTINCT d.word, g.word FROM g JOIN d ON g.rest = d.word),
c AS (SELECT a AS word, count(*) AS n_near, min(struct_pack(less := -d.n, other := d.word)) AS best FROM e JOIN d ON d.word = e.b GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * n THEN best.other END AS form, CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n FROM d LEFT JOIN c USING (word)),
p AS (SELECT word, word AS root, 0 AS far FROM f UNION ALL SELECT p.word, f.form, far + 1 FROM p JOIN f ON f.word = p.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, far) AS root FROM p GROUP BY word) USING (word)"""

OP13 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

SQL = {
    "op3_host_rules": OP3,
    "op7_near_dedup": OP7,
    "op8_substring_dedup": repeats(35),
    "op9_decontaminate": OP9,
    "op10_suffix_dedup": repeats(50),
    "op11_filter_audit": OP11,
    "op12_spelling": OP12,
    "op13_exact_search": OP13,
}
