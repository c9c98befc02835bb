"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .quality import METRICS

OP10 = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln,
    row_number() OVER () AS r
  FROM documents
), win AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), f AS (
  SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ln) - len(list_distinct(ln)) AS n_dup_lines, len(ln) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)
), m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols * 1000 // greatest(word_chars, 1) AS symbols, word_chars * 100 // greatest(n_words, 1) AS mean_length, CASE {" ".join(f"WHEN mean_length >= {10**k} THEN mean_length - mean_length % {10 ** (k - 2)}" for k in range(18, 2, -1))} ELSE mean_length END AS word_length,
    n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines
  FROM f
), cells AS (
  SELECT lang, source, u.metric, u.cell FROM (
    SELECT lang, source, unnest([{", ".join(f"{{'metric': '{m.name}', 'cell': {m.name}}}" for m in METRICS)}]) AS u FROM m WHERE NOT base_failed)
), levels AS (
  SELECT 2 AS lvl, lang, source, metric, cell FROM cells
  UNION ALL SELECT 1, lang, NULL, metric, cell FROM cells
  UNION ALL SELECT 0, NULL, NULL, metric, cell FROM cells
), marks AS (
  SELECT lvl, lang, source, metric, count(*) AS docs, quantile_disc(cell, 0.1) AS p10, quantile_disc(cell, 0.5) AS p50, quantile_disc(cell, 0.75) AS p75, quantile_disc(cell, 0.9) AS p90
  FROM levels GROUP BY ALL
), fences AS (
  SELECT lvl, lang, source, metric, docs, CASE WHEN metric IN ({", ".join(f"'{m.name}'" for m in METRICS if m.two_sided)}) THEN p50 + 4 * (p50 - p10) ELSE greatest(p50 + 4 * (p50 - p10), p75 + 4 * (p75 - p50)) END + CASE metric {" ".join(f"WHEN '{m.name}' THEN {m.spread}" for m in METRICS)} END AS high,
    CASE {" ".join(f"WHEN metric = '{m.name}' THEN p50 - 4 * (p90 - p50) - {m.spread}" for m in METRICS if m.two_sided)} ELSE -1 END AS low
  FROM marks
), chosen AS (
  SELECT g.lang, g.source, g.metric,
    CASE WHEN a.docs >= 200 THEN a.low WHEN b.docs >= 200 THEN b.low ELSE c.low END AS low,
    CASE WHEN a.docs >= 200 THEN a.high WHEN b.docs >= 200 THEN b.high ELSE c.high END AS high
  FROM (SELECT DISTINCT lang, source, metric FROM cells) g
  LEFT JOIN fences a ON a.lvl = 2 AND a.lang IS NOT DISTINCT FROM g.lang AND a.source IS NOT DISTINCT FROM g.source AND a.metric = g.metric
  LEFT JOIN fences b ON b.lvl = 1 AND b.lang IS NOT DISTINCT FROM g.lang AND b.metric = g.metric
  LEFT JOIN fences c ON c.lvl = 0 AND c.metric = g.metric
), wide AS (
  SELECT lang, source, {", ".join(f"max(low) FILTER (metric = '{m.name}') AS l_{m.name}, max(high) FILTER (metric = '{m.name}') AS h_{m.name}" for m in METRICS)}
  FROM chosen GROUP BY lang, source
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"coalesce({m.name} BETWEEN l_{m.name} AND h_{m.name}, true)" for m in METRICS)} AS kept
FROM m LEFT JOIN wide ON wide.lang IS NOT DISTINCT FROM m.lang AND wide.source IS NOT DISTINCT FROM m.source
"""

OP6 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), k AS (
  SELECT w, row_number() OVER () AS c FROM (SELECT DISTINCT w FROM d WHERE len(w) > 0)
), g AS (
  SELECT DISTINCT c, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS s FROM k
), n AS (
  SELECT c, count(*) AS n FROM g GROUP BY c
), pair AS (
  SELECT a.c, b.c AS o, count(*) AS n FROM g a JOIN g b ON a.s = b.s AND a.c < b.c GROUP BY a.c, b.c
), link AS (
  SELECT pair.c, pair.o FROM pair JOIN n x ON x.c = pair.c JOIN n y ON y.c = pair.o WHERE 100 * pair.n >= 90 * (x.n + y.n - pair.n)
), node AS (  -- a text's class and the ids that have it
  SELECT c, doc_id FROM d JOIN k USING (w)
), edge AS (
  SELECT c, o FROM link UNION SELECT o, c FROM link UNION SELECT a.c, b.c FROM node a JOIN node b ON a.doc_id = b.doc_id AND a.c <> b.c
), reach AS (
  SELECT c, c AS o FROM k UNION SELECT reach.c, edge.o FROM reach JOIN edge ON edge.c = reach.o
), least AS (
  SELECT reach.c, min(node.doc_id) AS id FROM reach JOIN node ON node.c = reach.o GROUP BY reach.c
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least.id, d.doc_id) AS component_id
FROM d LEFT JOIN k USING (w) LEFT JOIN n ON n.c = k.c LEFT JOIN least ON least.c = k.c
"""

OP9 = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN later THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN later THEN first END AS refers_to, url
FROM (
  SELECT *, payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL AS later
  FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM (
    SELECT page_id, url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages))
)
"""

#: CRC-32 is spelled out by its table, which comes from the polynomial.
OP13 = r"""
WITH tab AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab
), texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark
), w AS (
  SELECT kind, r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM texts
), f AS (
  SELECT kind, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w
), n AS (
  SELECT kind, r, f, count(*) AS n FROM f GROUP BY ALL
), bytes AS (
  SELECT f, list_transform(range(0, octet_length(encode(f))), lambda i: (instr('0123456789ABCDEF', substr(hex(encode(f)), 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex(encode(f)), 2 * i + 2, 1)) - 1) AS b
  FROM (SELECT DISTINCT f FROM n)
), h AS (
  SELECT f, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, tab
), each AS (
  SELECT kind, r, bucket, sum(n) AS n FROM n JOIN h USING (f) GROUP BY ALL
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 't'), 0) AS t FROM each GROUP BY bucket
), total AS (
  SELECT sum(s) AS alls, sum(t) AS allt FROM counts
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(alls + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(allt + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM counts, total
), weight AS (
  SELECT r, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight, CAST(sum(n) AS BIGINT) AS n_features FROM each JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN weight USING (r) WHERE kind = 'd'
), placed AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_words, n_features, weight) END AS place, count(*) FILTER (n_words >= 20) OVER () AS eligible FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * eligible // 100 THEN place END AS rank FROM placed
"""

ORACLE_SQL = {"op6_jaccard_join": OP6, "op9_warc": OP9, "op10_quality_rules": OP10, "op13_importance_resampling": OP13}
