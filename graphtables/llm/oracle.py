"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from graphtables.llm.licenses import ANCHOR, FILE_SHARE, MIN_COSINE, PASSAGE_LINES, TEMPLATES

WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"

OP8 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, {WORDS} AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), again AS (
  SELECT rid, win FROM g GROUP BY rid, win HAVING count(*) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n
  FROM g JOIN again USING (rid, win), (SELECT unnest(range(0, 5)) AS k) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: NOT regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS letterless,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower
  FROM w LEFT JOIN covered USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words
            OR 2 * n_dup_lines > n_lines OR (n_words >= 20 AND 10 * letterless > 4 * n_words) OR n_upper > n_lower
            OR word_chars < 2 * n_words OR word_chars > 12 * n_words) AS kept
FROM m
"""

OP6 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), h AS (
  SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS hex FROM p
), q AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  (((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '')
           AS payload_digest
  FROM h
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM q
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', " \
         r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {FOLDED} AS ws FROM documents
), b AS (
  SELECT item_id, {FOLDED} AS ws FROM benchmark
), p AS (
  SELECT DISTINCT item_id, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win, least(len(ws), 10) AS n
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM p
), g AS (
  SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)
), h AS (SELECT rid, i, g.n, item_id FROM g JOIN p USING (win)
), c AS (
  SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM h) GROUP BY rid
), t AS (
  SELECT rid, count(DISTINCT item_id) AS n_items,
         array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids FROM h GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""

_NOTICES = ", ".join("({}, '{}', '{}')".format(n, name, text) for n, (name, text) in enumerate(TEMPLATES))
_WINDOWS = " UNION ".join(
    f"SELECT rid, array_to_string(ls[i:i + {n - 1}], chr(10)) AS p FROM (SELECT rid, ls, "
    f"unnest(range(1, greatest(len(ls) - {n - 1}, 1) + 1)) AS i FROM l)" for n in PASSAGE_LINES)

OP5 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         concat_ws('/', source, (doc_id // 400)::VARCHAR, (doc_id // 100)::VARCHAR) AS dir,
         concat_ws('/', source, (doc_id // 400)::VARCHAR, (doc_id // 100)::VARCHAR, doc_id || '.txt') AS path
  FROM documents
), l AS (
  SELECT rid, string_split(t, chr(10)) AS ls FROM d WHERE regexp_matches(lower(t), '{ANCHOR}')
), w AS (
  SELECT DISTINCT rid, p FROM ({_WINDOWS}) WHERE regexp_matches(lower(p), '{ANCHOR}')
), ut AS (
  SELECT rid, p, term, count(*) AS tf
  FROM (SELECT rid, p, unnest(regexp_extract_all(lower(p), '[a-z0-9]+')) AS term FROM w) GROUP BY ALL
), tt AS (
  SELECT n, license, term, count(*) AS tf FROM (
    SELECT n, license, unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) AS term
    FROM (VALUES {_NOTICES}) v(n, license, x)) GROUP BY ALL
), df AS (
  SELECT term, count(*) AS df FROM (
    SELECT unnest(list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+'))) AS term FROM d) GROUP BY term
), idf AS (
  SELECT term, ln((1.0 + (SELECT count(*) FROM d)) / (1.0 + coalesce(df, 0))) + 1 AS idf
  FROM (SELECT term FROM ut UNION SELECT term FROM tt) LEFT JOIN df USING (term)
), nu AS (SELECT rid, p, sqrt(sum((tf * idf) ** 2)) AS nu FROM ut JOIN idf USING (term) GROUP BY ALL
), nt AS (SELECT n, sqrt(sum((tf * idf) ** 2)) AS nt FROM tt JOIN idf USING (term) GROUP BY ALL
), s AS (
  SELECT rid, p, n, license, round(sum(ut.tf * idf * tt.tf * idf) / (any_value(nu) * any_value(nt)), 6) AS c
  FROM ut JOIN tt USING (term) JOIN idf USING (term) JOIN nu USING (rid, p) JOIN nt USING (n) GROUP BY ALL
), own AS (
  SELECT rid, license, c AS cosine, length(p) AS chars
  FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY c DESC, license, length(p)) AS k
        FROM s WHERE c >= {MIN_COSINE}) WHERE k = 1
), f AS (SELECT d.rid, doc_id, dir, path, t, license, cosine, chars FROM d LEFT JOIN own USING (rid)
), g AS (
  SELECT dir, license, path FROM (
    SELECT *, row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path) AS k
    FROM f WHERE license IS NOT NULL AND chars >= {FILE_SHARE} * length(t)) WHERE k = 1
), h AS (
  SELECT f.dir, max_by(g.license, length(g.dir)) AS license, max_by(g.path, length(g.dir)) AS path
  FROM (SELECT DISTINCT dir FROM f) f JOIN g ON f.dir = g.dir OR starts_with(f.dir, g.dir || '/') GROUP BY f.dir
)
SELECT doc_id, f.path, coalesce(f.license, h.license) AS license, cosine,
       CASE WHEN f.license IS NOT NULL THEN 'own' WHEN h.license IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN f.license IS NULL THEN h.path END AS license_path
FROM f LEFT JOIN h USING (dir)
"""

ORACLE = {"op5_license_inheritance": OP5, "op7_fm_decontamination": OP7, "op6_warc_chain": OP6, "op8_quality_cascade": OP8}
