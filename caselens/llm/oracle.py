"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from caselens.llm import quality

WORD = r"[^\x20\x09-\x0D]+"
_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

OP3 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(text, '{WORD}') AS words,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines FROM t),
p AS (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
g AS (SELECT r, i, array_to_string(words[i:i+4], ' ') AS gram FROM p),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
rep AS (SELECT r, count(DISTINCT i + k.d) AS n FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS d) k GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words,
        len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words,
        len(text) - len(regexp_replace(text, '[!?]', '', 'g')) AS n_shouts,
        len(list_filter(regexp_extract_all(lower(text), '[^\x20\x09-\x0D.,;:!?"''()]+'),
            lambda x: list_contains([{_STOP}], x))) AS n_stop
      FROM w LEFT JOIN rep USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND coalesce(word_chars / n_words BETWEEN 2.0 AND 20.0, true)
    AND coalesce(n_symbols / n_words <= 0.1, true) AND coalesce(n_shouts / n_words <= 0.3, true)
    AND (n_words < {quality.STOP_WORDS_FROM} OR n_stop / n_words >= 0.02)
    AND coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.5, true) AS kept
FROM m
"""

OP4 = f"""
WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT) >> (15 - 5 * (k % 4))) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

OP8 = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE
    WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM t),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) + any_value(b.n) AS n
      FROM e a JOIN e b USING (x) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * k >= 85 * (n - k)),
ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT ways.b, reach.c FROM reach JOIN ways ON reach.id = ways.a WHERE reach.c < ways.b),
least AS (SELECT id, min(c) AS c FROM reach GROUP BY 1)
SELECT doc_id, len(g)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN least ON doc_id = id
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_filter(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS ln FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n, any_value(ln) AS ln FROM o JOIN k USING (lang, term) GROUP BY 1, 2, 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(ln)::HUGEINT AS total FROM k GROUP BY 1),
t AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
cell AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000 * (coalesce(c.n, 0) + 2) // (t.total + 2 * l.v) AS p, 1 + 1000000000 * (k.ln + 2) // (l.total + 2 * l.v) AS q
  FROM t JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN cell x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN cell y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM cell WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT, rank::INT
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term) WHERE rank <= 10
"""

OP13 = r"""
WITH one AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS tab),
f AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', 0, item_id, text FROM benchmark),
w AS (SELECT side, r, doc_id, list_filter(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM f),
o AS (SELECT side, r, unnest(w) AS term FROM w),
b AS (SELECT term, (xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(hex(encode(term))) // 2),
    lambda i: ('0x' || substr(hex(encode(term)), 2 * i + 1, 2))::BIGINT)), lambda a, x: xor(a // 256, tab[xor(a, x) % 256 + 1])), 4294967295::BIGINT) % 10000) AS bucket
  FROM (SELECT DISTINCT term FROM o), one),
s AS (SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM o JOIN b USING (term) GROUP BY 1),
a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM s),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain FROM s, a),
e AS (SELECT r, sum(gain)::BIGINT AS weight FROM o JOIN b USING (term) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
m AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN e USING (r) WHERE side = 'd'),
z AS (SELECT r, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM m),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM z LEFT JOIN k USING (r)
"""

SQL = {
    "op3_quality_rules": OP3,
    "op4_warc_archive": OP4,
    "op8_bbit_minhash": OP8,
    "op11_level_products": OP11,
    "op13_position_crc_resample": OP13,
}
