"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

OP10 = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
b AS (SELECT *, 16 * length(bin(size)) + size * 16 // (1::BIGINT << (length(bin(size)) - 1)) AS band,
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/10'), 1, 4) AS BIGINT) % 64 AS salt FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
             row_number() OVER (ORDER BY source COLLATE C NULLS LAST) AS rank,
             source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
l AS (SELECT *, cap / weight AS fill,
             (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size,
             least(cap, coalesce((SELECT level FROM l WHERE level <= fill ORDER BY fill, rank LIMIT 1) * weight, cap)) AS target,
             CAST('0x' || substr(md5(coalesce(source, '') || '/10'), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS off FROM l),
n AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY band, salt, size, doc_id NULLS FIRST) AS k FROM b),
c AS (SELECT n.doc_id, n.source, n.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate, t.off, n.k
      FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       CAST(floor(off + k * rate) - floor(off + (k - 1) * rate) AS BIGINT) AS copies,
       CAST((floor(off + k * rate) - floor(off + (k - 1) * rate)) * size AS BIGINT) AS taken FROM c
"""

OP4 = r"""
WITH k(rank, kind, pattern) AS (VALUES
  (0, 'assign', '((?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))'),
  (1, 'access', '(AKIA[A-Z0-9]{12,})'),
  (2, 'hex', '([0-9a-f]{32,})'),
  (3, 'github', '(gh[opsu]_[A-Za-z0-9]{36,})'),
  (4, 'jwt', '(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)'),
  (5, 'pem', '(-----BEGIN [A-Z ]*PRIVATE KEY-----)')),
d AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(65533) || chr(65533)) AS text FROM documents),
p AS (SELECT row, rank, kind, pattern, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS nth
      FROM (SELECT row, rank, kind, pattern, string_split(CASE rank
              WHEN 0 THEN regexp_replace(text, '((?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', chr(1) || '\1' || chr(2), 'g')
              WHEN 1 THEN regexp_replace(text, '(AKIA[A-Z0-9]{12,})', chr(1) || '\1' || chr(2), 'g')
              WHEN 2 THEN regexp_replace(text, '([0-9a-f]{32,})', chr(1) || '\1' || chr(2), 'g')
              WHEN 3 THEN regexp_replace(text, '(gh[opsu]_[A-Za-z0-9]{36,})', chr(1) || '\1' || chr(2), 'g')
              WHEN 4 THEN regexp_replace(text, '(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)', chr(1) || '\1' || chr(2), 'g')
              ELSE regexp_replace(text, '(-----BEGIN [A-Z ]*PRIVATE KEY-----)', chr(1) || '\1' || chr(2), 'g') END, chr(1)) AS parts
            FROM d CROSS JOIN k)),
m AS (SELECT row, rank, kind, nth, split_part(part, chr(2), 1) AS match,
             CAST(coalesce(sum(length(part) - CASE WHEN nth > 0 THEN 1 ELSE 0 END)
               OVER (PARTITION BY row, rank ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p),
s AS (SELECT row, rank, kind, start, start + length(match) AS stop FROM m
      WHERE nth > 0 AND (rank <> 0 OR length(regexp_extract(match, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) >= 8)),
g AS (SELECT row, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row)
"""

OP1 = r"""
WITH d AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
                  row_number() OVER (PARTITION BY page_id, html ORDER BY url) AS nth FROM pages),
e AS (SELECT *, list_reduce(list_transform(list_transform(range(1, 41, 5), lambda i: CAST('0x' || substr(hex, CAST(i AS INT), 5) AS BIGINT)), lambda v:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 15) % 32 + 1 AS INT), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 10) % 32 + 1 AS INT), 1) ||
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 5) % 32 + 1 AS INT), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v % 32 + 1 AS INT), 1)),
        lambda a, b: a || b) AS payload_digest, min(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first AND nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first AND nth = 1 THEN NULL ELSE first END AS refers_to,
       strftime(TIMESTAMP '2024-01-01' + to_seconds(coalesce(page_id, 0)), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
FROM e
"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS one, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS two,
             CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                  WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(text, 1, least(one, two)) AS prefix, substr(text, least(one, two) + 1, abs(one - two)) AS middle, substr(text, greatest(one, two) + 1) AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
