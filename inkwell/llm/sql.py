"""DuckDB SQL for the numbered queries that SQL can express."""

OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 4),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i+1], w[i+2]) AS c FROM p),
h AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY k),
m AS (SELECT w.k, doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words,
  length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^0-9]+', '', 'g')) AS n_digits, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_bangs
  FROM w LEFT JOIN h ON h.k = w.k),
r AS (SELECT *, CAST(n_words < 50 AS INT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS INT) + 4 * CAST(10 * n_symbols > n_words AS INT) + 8 * CAST(10 * n_upper > 4 * word_chars AS INT)
  + 16 * CAST(20 * n_bangs > n_words AS INT) + 32 * CAST(100 * n_dup_lines > 30 * n_lines AS INT) + 64 * CAST(word_chars < 2 * n_words AS INT) + 128 * CAST(word_chars > 15 * n_words AS INT)
  + 256 * CAST(10 * n_digits > 3 * word_chars AS INT) AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 63) = 0 AS kept, CAST(failed AS BIGINT) AS failed FROM r
"""

OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT k, i, dw.n, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.s = dw.s),
hw AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM hit) GROUP BY k),
hi AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit WHERE item_id IS NOT NULL GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON hw.k = d.k LEFT JOIN hi ON hi.k = d.k
"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
  CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(l[1:a], '') AS x, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || x || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

# crc32 by its table, made by rule from the polynomial 0xEDB88320; near words by common deletions
OP12 = r"""
WITH RECURSIVE tb AS (SELECT list(c ORDER BY i) AS tb FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
g AS (SELECT w, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x, count(*) AS n FROM r GROUP BY doc_id, w),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))), lambda c, b: xor(c >> 8, tb[(xor(c, b) & 255) + 1]))) AS h FROM g, tb),
e AS (SELECT CASE WHEN h % 97 = 0 THEN w[1:h % len(w)] || w[h % len(w) + 2:] ELSE w END AS w, n FROM h),
v AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
l AS (SELECT DISTINCT w, n, i, w[1:i] || w[i + 2:] AS s FROM (SELECT w, n, unnest(range(length(w))) AS i FROM v)),
q AS (SELECT a.w AS w, b.w AS o, b.n AS m FROM l a JOIN l b ON a.i = b.i AND a.s = b.s AND a.w <> b.w AND length(a.w) = length(b.w)
  UNION SELECT l.w, v.w, v.n FROM l JOIN v ON v.w = l.s UNION SELECT v.w, l.w, l.n FROM l JOIN v ON v.w = l.s),
k AS (SELECT w, count(*) AS n_near, max(m) AS m FROM q GROUP BY w),
f AS (SELECT v.w AS word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN (SELECT min(o) FROM q WHERE q.w = v.w AND q.m = k.m) END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN k ON k.w = v.w),
t AS (SELECT word, word AS root, 0 AS depth FROM f UNION ALL SELECT t.word, f.form, depth + 1 FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL),
z AS (SELECT word, arg_max(root, depth) AS root FROM t GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON z.word = f.word
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
s AS (SELECT k, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
y AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS y FROM s),
c AS (SELECT y, max(doc_id) AS holder FROM y WHERE length(y) >= 20 GROUP BY y HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INT)) >= 3),
m AS (SELECT k, doc_id, i, line, holder IS NOT NULL AND doc_id IS DISTINCT FROM holder AS lost FROM y LEFT JOIN c ON c.y = y.y)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256 FROM m GROUP BY k
"""

SQL = {"op2_quality_rules": OP2, "op3_decontaminate": OP3, "op11_fill_in_middle": OP11, "op12_spelling_variants": OP12, "op13_line_dedup": OP13}
