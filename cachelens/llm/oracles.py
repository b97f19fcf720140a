"""DuckDB SQL of the queries that SQL can express."""

#: Words between ASCII white space; and words of ASCII letters, digits and everything beyond ASCII.
PLAIN = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{PLAIN}') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT doc_id, source, line, regexp_extract_all({_LOWER.format('line')}, '{PLAIN}') AS lw FROM l),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM k WHERE len(lw) > 0 GROUP BY doc_id),
c AS (SELECT doc_id, source, lw, sum(len(lw)) AS words FROM k WHERE len(lw) > 0 GROUP BY doc_id, source, lw),
h AS (SELECT source AS s, greatest(20, count(*) * 0.01) AS most FROM documents GROUP BY source),
b AS (SELECT source, lw FROM c JOIN h ON s IS NOT DISTINCT FROM source GROUP BY source, lw, most HAVING count(*) > most),
x AS (SELECT doc_id, sum(words) AS removed_words, count(*) AS n_removed_lines FROM c JOIN b ON b.lw = c.lw AND b.source IS NOT DISTINCT FROM c.source GROUP BY doc_id),
a AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS word_chars,
len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
coalesce(removed_words, 0) AS removed_words, coalesce(n_removed_lines, 0) AS n_removed_lines
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN x USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND n_words - removed_words >= 50 AND n_words - removed_words >= 0.5 * n_words AS kept,
removed_words::BIGINT AS removed_words, n_removed_lines::BIGINT AS n_removed_lines FROM f"""

_BASE32 = "list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(p), i * 5 + 1, 5))::BIGINT >> s) & 31)::INT + 1, 1)), 'string_agg', '')), 'string_agg', '')"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY p) AS top FROM p)
SELECT page_id, octet_length(encode(p))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM w"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM benchmark),
k AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, w[i:i + k - 1] AS g FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
ks AS (SELECT DISTINCT k FROM k),
dw AS (SELECT doc_id, k, i, w[i:i + k - 1] AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)"""

NEAR_DUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{PLAIN}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(w[i:i + 4]) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT c.node, s.b FROM c JOIN s ON s.a = c.seen)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT node AS doc_id, min(seen) AS component_id FROM c GROUP BY node) LEFT JOIN n USING (doc_id)"""



def _share_out(level: int) -> str:
    """Budgets of the nodes of a level, water-filled among siblings: full are those of least capacity by weight, up to the
    first that the level of what is left does not fill."""
    path, parent = ", ".join(f"l{k}" for k in range(level + 1)), ", ".join(f"l{k}" for k in range(level))
    by = f"PARTITION BY {', '.join(f'n.l{k}' for k in range(level))}" if level else ""
    order = "ORDER BY capacity / weight, n.l" + str(level)
    same = " AND ".join(f"n.l{k} IS NOT DISTINCT FROM u.l{k}" for k in range(level)) or "true"
    group = f"PARTITION BY {parent}" if level else ""
    return f"""
n{level} AS (SELECT {path}, sum(tokens) AS tokens, 2.0 * sum(tokens) AS capacity, pow(sum(tokens), 0.7) AS weight FROM leaf GROUP BY {path}),
f{level} AS (SELECT n.*, capacity / weight AS ratio, (u.given - coalesce(sum(capacity) OVER ({by} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
 / sum(weight) OVER ({by} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mark FROM n{level} n JOIN g{level} u ON {same}),
g{level + 1} AS (SELECT {path}, CASE WHEN least_open IS NULL OR ratio <= least_open THEN least(capacity, coalesce(least_open * weight, capacity)) ELSE least_open * weight END AS given
 FROM (SELECT *, min_by(mark, ratio) FILTER (ratio > mark) OVER ({group}) AS least_open FROM f{level})),"""


MIXING = rf"""
WITH d AS (SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '{PLAIN}')) AS n,
 'domain' || coalesce((try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) // 5)::VARCHAR, '-') AS l0, lang AS l1, source AS l2 FROM documents),
t AS (SELECT * FROM d WHERE n > 0), leaf AS (SELECT l0, l1, l2, sum(n) AS tokens FROM t GROUP BY ALL),
g0 AS (SELECT floor(0.9::DOUBLE * sum(tokens)) AS given FROM leaf),{"".join(map(_share_out, range(3)))}
w AS (SELECT *, floor(given + 1e-6) AS whole FROM g3),
r AS (SELECT *, whole + CASE WHEN row_number() OVER (ORDER BY whole - given, l0 NULLS FIRST, l1 NULLS FIRST, l2 NULLS FIRST) <= (SELECT floor(sum(given) + 1e-6) - sum(whole) FROM w) THEN 1 ELSE 0 END AS budget FROM w),
e AS (SELECT t.*, epoch, least(greatest(budget - epoch * tokens, 0), tokens) AS allowed,
 ('0x' || substr(md5('20240701|' || epoch || '|' || doc_id), 1, 15))::BIGINT AS key
 FROM t JOIN r ON t.l0 IS NOT DISTINCT FROM r.l0 AND t.l1 IS NOT DISTINCT FROM r.l1 AND t.l2 IS NOT DISTINCT FROM r.l2
 JOIN leaf ON t.l0 IS NOT DISTINCT FROM leaf.l0 AND t.l1 IS NOT DISTINCT FROM leaf.l1 AND t.l2 IS NOT DISTINCT FROM leaf.l2, (SELECT unnest([0, 1]) AS epoch)),
c AS (SELECT *, allowed - coalesce(sum(n) OVER (PARTITION BY l0, l1, l2, epoch ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over FROM e)
SELECT doc_id, lang, source, epoch::INTEGER AS epoch, n::BIGINT AS n_tokens, least(n, left_over)::BIGINT AS taken_tokens FROM c WHERE left_over > 0"""

SQL = {"op2_quality_rules": QUALITY_RULES, "op4_warc": WARC, "op6_mixing": MIXING, "op8_decontamination": DECONTAMINATION, "op9_near_dup": NEAR_DUP}
