"""SQL twins (DuckDB) of the text queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
),
windows AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM words)
),
repeated AS (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS word
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS found FROM windows)
  WHERE found > 1
),
covered AS (SELECT doc_id, count(DISTINCT word) AS n FROM repeated GROUP BY doc_id),
measured AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered USING (doc_id)
),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words
           OR 100 * n_dup_lines > 30 * n_lines AS failed
  FROM measured
),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE failed) AS f FROM judged GROUP BY source
),
moments AS (
  SELECT sum(f) / sum(n) AS mean, sum(n) AS docs, count(*) AS hosts,
         sum(f::DOUBLE * f / n) / sum(n) AS square
  FROM hosts
),
prior AS (
  SELECT CASE WHEN mean * (1 - mean) <= 0 THEN mean * hosts + 1 ELSE mean * strength END AS a,
         CASE WHEN mean * (1 - mean) <= 0 THEN (1 - mean) * hosts + 1
              ELSE (1 - mean) * strength END AS b
  FROM (
    SELECT *, least(greatest(mean * (1 - mean) / greatest(
               greatest(square - mean * mean, 0) - mean * (1 - mean) * (hosts - 1) / docs,
               mean * (1 - mean) * 1e-6) - 1, 2), 1e6) AS strength
    FROM moments WHERE mean IS NOT NULL
  )
),
verdicts AS (
  SELECT source, n, f, CASE WHEN (f + a) / (n + a + b) > 0.8 THEN 'blocked'
                            WHEN (f + a) / (n + a + b) > 0.5 THEN 'suspect' ELSE 'ok' END AS verdict
  FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND verdict <> 'blocked' AND (verdict = 'ok' OR NOT failed) AS kept,
       n AS host_docs, f AS host_failures, verdict AS host_verdict
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""

OP4 = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
),
item_words AS (
  SELECT item_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
),
patterns AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS w
  FROM (SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i
        FROM item_words WHERE len(ws) > 0)
),
windows AS (
  SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS w
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
        FROM doc_words, (SELECT DISTINCT m FROM patterns) WHERE len(ws) >= m)
),
found AS (SELECT DISTINCT doc_id, m, i, item_id FROM windows JOIN patterns USING (m, w)),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
),
hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT doc_id, m, i FROM found))
  GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP11_ROUND = r"""
near{k} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(entry, d * 1000 + entry) AS entry, min(d) AS d FROM (
    SELECT x.vec_id, x.p, b.entry,
           list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))::BIGINT AS d
    FROM parts x JOIN book{k} b USING (p)
  ) GROUP BY vec_id, p
),
"""

_OP11_BOOK = r"""
moved{k} AS (
  SELECT p, entry, i, floor(sum(c) / count(*))::BIGINT AS c
  FROM (SELECT p, near{k}.entry, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS c
        FROM near{k} JOIN parts USING (vec_id, p))
  GROUP BY p, entry, i
),
book{next} AS MATERIALIZED (
  SELECT p, entry, coalesce(m.v, b.v) AS v
  FROM book{k} b LEFT JOIN (SELECT p, entry, list(c ORDER BY i) AS v FROM moved{k} GROUP BY p, entry) m USING (p, entry)
),
"""

OP11 = (
    r"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS v
  FROM kept, (SELECT unnest(range(4)) AS p)
),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256),
book0 AS MATERIALIZED (SELECT p, entry, v FROM seeds JOIN parts USING (vec_id)),
"""
    + "".join(_OP11_ROUND.format(k=k) + _OP11_BOOK.format(k=k, next=k + 1) for k in range(4))
    + _OP11_ROUND.format(k=4)
    + r"""
found AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM near4 GROUP BY vec_id
),
digest AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM book4
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN found USING (vec_id), digest
"""
)

OP12 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
),
drawn AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM cut
),
formed AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50
                 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high
  FROM drawn
),
split AS (
  SELECT doc_id, n, form, t, array_to_string(units[1:low], '') AS prefix,
         array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix
  FROM formed
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM split
"""

OP13 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n FROM documents
),
pairs AS (
  SELECT *, coalesce(lead(t) OVER o, first_value(t) OVER o) AS next_t,
         coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id
  FROM texts WINDOW o AS (ORDER BY doc_id)
),
edits AS (SELECT *, left(t, n - n // 2) || left(next_t, n // 2) AS edited FROM pairs),
both_texts AS (SELECT doc_id, 0 AS kind, t FROM edits UNION ALL SELECT doc_id, 1, edited FROM edits),
lines AS (
  SELECT doc_id, kind, l FROM (SELECT doc_id, kind, unnest(string_split(t, chr(10))) AS l FROM both_texts)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
),
entries AS (
  SELECT l, k, (v & 4294901762) - 1 AS e FROM (
    SELECT l, k, ('0x' || substr(sha256((k // 8) || ':' || l), 8 * (k % 8) + 1, 8))::BIGINT AS v
    FROM (SELECT DISTINCT l FROM lines), (SELECT unnest(range(128)) AS k)
  )
),
sums AS (
  SELECT doc_id, kind, k, ((sum(e) % 4294967296 + 4294967296) % 4294967296)::BIGINT AS s
  FROM lines JOIN entries USING (l) GROUP BY doc_id, kind, k
),
prints AS (
  SELECT doc_id, kind, string_agg(printf('%08x', coalesce(s, 0)), '' ORDER BY k) AS print,
         list(CASE WHEN coalesce(s, 0) & 65535 >= 32768 THEN (s & 65535) - 65536 ELSE coalesce(s, 0) & 65535 END ORDER BY k) AS x
  FROM both_texts CROSS JOIN (SELECT unnest(range(128)) AS k) LEFT JOIN sums USING (doc_id, kind, k)
  GROUP BY doc_id, kind
),
three AS (
  SELECT d.doc_id, d.n, d.edited, d.next_id, a.print AS pa, b.print AS pb, c.print AS pc, a.x AS xa, b.x AS xb, c.x AS xc
  FROM edits d JOIN prints a ON a.doc_id = d.doc_id AND a.kind = 0
  JOIN prints b ON b.doc_id = d.doc_id AND b.kind = 1 JOIN prints c ON c.doc_id = d.next_id AND c.kind = 0
),
products AS (
  SELECT *, list_sum(list_transform(range(1, 129), lambda i: xa[i] * xa[i])) AS aa,
         list_sum(list_transform(range(1, 129), lambda i: xb[i] * xb[i])) AS bb,
         list_sum(list_transform(range(1, 129), lambda i: xc[i] * xc[i])) AS cc,
         list_sum(list_transform(range(1, 129), lambda i: xa[i] * xb[i])) AS ab,
         list_sum(list_transform(range(1, 129), lambda i: xa[i] * xc[i])) AS ac, repeat('0', 1024) AS zero
  FROM three
)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, pa AS fingerprint, pb AS edited_fingerprint,
       CASE WHEN pa = pb THEN 1.0::DOUBLE WHEN pa = zero OR pb = zero THEN 0.0::DOUBLE
            ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2.0::DOUBLE * ab::DOUBLE / (aa + bb)::DOUBLE)) END AS near_edited,
       CASE WHEN pa = pc THEN 1.0::DOUBLE WHEN pa = zero OR pc = zero THEN 0.0::DOUBLE
            ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2.0::DOUBLE * ac::DOUBLE / (aa + cc)::DOUBLE)) END AS near_next,
       next_id
FROM products
"""

TWINS: dict[str, str] = {
    "op2_host_rules": OP2,
    "op4_wu_manber": OP4,
    "op11_walsh_codes": OP11,
    "op12_fill_in_middle": OP12,
    "op13_multiset_hash": OP13,
}
