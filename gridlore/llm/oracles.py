"""SQL (DuckDB) for the queries of this subpackage that SQL can express."""

WORDS = r"'[^\x20\x09-\x0D]+'"

OP3 = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM w, range(1, len(w) - 11) t(i) WHERE len(w) >= 13),
m AS (SELECT g, min(doc_id) AS m FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, p FROM (SELECT g.doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (g) WHERE m.m < g.doc_id)),
n AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN n.n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN n ON w.doc_id = n.doc_id"""

ALNUM = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP5 = rf"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {ALNUM} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g FROM b, range(1, 100000) t(i) WHERE len(w) > 0 AND i <= greatest(1, len(w) - 9)),
d AS (SELECT doc_id, {ALNUM} AS w FROM documents),
k AS (SELECT DISTINCT n FROM p),
h AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, k, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
f AS (SELECT h.doc_id, h.i, h.n, p.item FROM h JOIN p ON h.g = p.g AND h.n = p.n),
x AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM f) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM f WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x ON d.doc_id = x.doc_id LEFT JOIN y ON d.doc_id = y.doc_id"""


_FAILS = r"""d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
    100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d),"""
OP11 = rf"""WITH {_FAILS}
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
t AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS t),
o AS (SELECT [v.t, w.t, x.t, y.t, z.t] AS o FROM t v, t w, t x, t y, t z WHERE len(list_distinct([v.t, w.t, x.t, y.t, z.t])) = 5),
s AS (SELECT o, step, o[step] AS x, o[1 : step - 1] AS before FROM o, range(1, 6) r(step)),
k AS (SELECT part, o, step, x, n, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda q, i: [a, b, c, d, e][i]) AS fails, before FROM m, s),
g AS (SELECT part, array_to_string(o, '') AS filter_order, step, x,
    sum(CASE WHEN list_contains(fails, x) OR list_has_any(fails, before) THEN 0 ELSE n END) AS kept,
    sum(CASE WHEN list_contains(fails, x) AND NOT list_has_any(fails, before) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN list_contains(fails, x) AND list_has_any(fails, before) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = [x] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN list_contains(fails, x) AND NOT list_has_any(fails, before) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN list_contains(fails, x) AND NOT list_has_any(fails, before) THEN toxic ELSE 0 END) AS toxic_lost FROM k GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM g"""

#: crc32 bit by bit: a byte of the id is taken in, then eight shifts follow.
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(CAST(conv_id AS VARCHAR), '')])),
  lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, 3988292384 * (r & 1)) END)"""
OP13 = rf"""WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, role, text
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, xor({_CRC}, 4294967295) % 4 AS h, conv_id - conv_id % 20 AS donor FROM (SELECT DISTINCT conv_id FROM o)),
b AS (SELECT c.conv_id, 0 AS k, p, role, text FROM c JOIN o ON o.conv_id = donor AND p <= h UNION ALL SELECT o.conv_id, 1, p, role, text FROM c JOIN o USING (conv_id) WHERE p > h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k, p) AS d, role, text FROM b),
a AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY d) AS s FROM r GROUP BY conv_id),
s AS (SELECT conv_id, coalesce(s, []) AS s FROM c LEFT JOIN a USING (conv_id)),
p AS (SELECT conv_id, d, s[1:d] AS q, len(s) = d AS last FROM s, LATERAL (SELECT unnest(range(0, len(s) + 1)) AS d)),
n AS (SELECT d, q, min(conv_id) AS m, count(*) AS n, sha256(coalesce(string_agg(CASE WHEN last THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends,
    CASE WHEN d > 0 THEN len(regexp_extract_all(q[d].t, '[^ 	-]+')) ELSE 0 END AS words FROM p GROUP BY d, q),
x AS (SELECT p.conv_id, p.d, n.m FROM p JOIN n ON p.d = n.d AND p.q = n.q),
e AS (SELECT n.m, n.d, x.m AS over, n.n, n.words, n.ends FROM n LEFT JOIN x ON x.conv_id = n.m AND x.d = n.d - 1),
k AS (SELECT over AS m, d - 1 AS d, count(*) AS n_children FROM e WHERE d > 0 GROUP BY ALL),
f AS (SELECT e.*, coalesce(n_children, 0) AS n_children FROM e LEFT JOIN k ON k.m = e.m AND k.d = e.d),
u AS (SELECT x.m, x.d, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n - 1) * f.words) AS saved FROM f JOIN x ON x.conv_id = f.m AND x.d <= f.d GROUP BY ALL)
SELECT f.m AS conv_id, CAST(f.d AS BIGINT) AS depth, over AS parent_conv_id, f.n AS n_convs, f.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, ends AS ends_sha256 FROM f JOIN u ON u.m = f.m AND u.d = f.d"""

def _op4() -> str:
    from .line_rules import BOILERPLATE

    phrases = " OR ".join(f"contains(a, '{p}')" for p in BOILERPLATE)
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, {WORDS}) AS w FROM d),
t AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, range(1, 1000000) q(i) WHERE i <= len(w) - 2),
tt AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM t),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM tt WHERE c > 1) GROUP BY r),
l0 AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
l1 AS (SELECT r, line, pos, regexp_extract_all(line, {WORDS}) AS w, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS a FROM l0),
l2 AS (SELECT *, len(w) AS n, row_number() OVER (PARTITION BY r, line ORDER BY pos) > 1 AS dup, len(regexp_extract_all(line, '[|]')) AS bars, len(regexp_extract_all(line, '[#*$%&|<>]')) AS syms,
  len(regexp_extract_all(line, '[A-Z]')) AS up, len(regexp_extract_all(line, '[a-z]')) AS lo, len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS rp, len(list_filter(w, lambda x: regexp_matches(x, '[.!?]$'))) AS stops,
  regexp_matches(w[len(w)], '[.!?;:"'')…”»。！？]$') AS ends FROM l1 WHERE len(w) > 0),
l3 AS (SELECT *, NOT (ends OR (n >= 20 AND stops > 0)) OR (bars >= 2 AND 5 * bars >= n) OR dup OR {phrases} OR (syms >= 3 AND 4 * syms > n) OR (n >= 4 AND 10 * up > 6 * (up + lo)) OR (n >= 4 AND 2 * rp > n) AS bad FROM l2),
l AS (SELECT r, count(*) FILTER (dup) AS dups, count(*) AS n_lines, count(*) FILTER (bad) AS n_failed, coalesce(sum(n) FILTER (NOT bad), 0) AS kept FROM l3 GROUP BY r),
a AS (SELECT w.doc_id, len(w.w) AS nw, length(array_to_string(w.w, '')) AS wc, len(regexp_extract_all(text, '[#*$%&|<>]')) AS sy, coalesce(l.dups, 0) AS dl, coalesce(rep.n, 0) AS rw, coalesce(n_lines, 0) AS nl, coalesce(n_failed, 0) AS nf, coalesce(kept, 0) AS kw FROM w LEFT JOIN l ON w.r = l.r LEFT JOIN rep ON w.r = rep.r)
SELECT doc_id, CAST(nw AS BIGINT) AS n_words, CAST(coalesce(wc, 0) AS BIGINT) AS word_chars, CAST(sy AS BIGINT) AS n_symbols, CAST(dl AS BIGINT) AS n_dup_lines, CAST(rw AS BIGINT) AS n_repeat_words, nw < 50 OR 100 * rw > 50 * nw AS base_failed,
  NOT (nw < 50 OR 100 * rw > 50 * nw) AND 2 * kw >= nw AS kept, CAST(nl AS BIGINT) AS n_lines, CAST(nf AS BIGINT) AS n_failed_lines, CAST(kw AS BIGINT) AS kept_words FROM a"""


OP4 = _op4()

OP10 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM w, range(1, 1000000) t(i) WHERE len(w) > 0 AND i <= greatest(1, len(w) - 4)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS digest FROM s GROUP BY doc_id),
c AS (SELECT digest, min(doc_id) AS rep, count(*) AS copies, any_value(n) AS n FROM n GROUP BY digest),
q AS (SELECT s.doc_id, s.g FROM s JOIN c ON s.doc_id = c.rep),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM q a JOIN q b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e0 AS (SELECT a, b FROM i JOIN c x ON x.rep = a JOIN c y ON y.rep = b WHERE 1000 * shared >= 800 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0),
k AS (SELECT e.a AS rep, sum(y.copies) AS links FROM e JOIN c y ON y.rep = e.b GROUP BY e.a),
r(node, root) AS (SELECT rep, rep FROM c UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a WHERE r.root < e.b),
m AS (SELECT node, min(root) AS class_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(m.class_id, w.doc_id) AS class_id, CAST(coalesce(k.links, 0) + coalesce(c.copies, 1) - 1 AS BIGINT) AS n_links, CAST(coalesce(c.copies, 1) AS BIGINT) AS copies
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.digest = n.digest LEFT JOIN m ON m.node = c.rep LEFT JOIN k ON k.rep = c.rep"""
