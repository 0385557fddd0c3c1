"""DuckDB SQL for the queries that SQL can express."""

OP7_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 't' || text, '')), 1, 15) AS BIGINT) AS h
  FROM documents
), total AS (SELECT 1.5 * sum(size) AS t FROM sized),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS pos FROM sized GROUP BY source
), weighted AS (
  SELECT *, CAST(CASE (pos - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w FROM src
), ranked AS (
  SELECT *, 2.0 * source_size / w AS full_at,
         t - 2.0 * coalesce(sum(source_size) OVER (ORDER BY 2.0 * source_size / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(w) OVER (ORDER BY 2.0 * source_size / w DESC, pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_w
  FROM weighted, total
), level AS (SELECT arg_min(left_over / open_w, full_at) FILTER (left_over / open_w <= full_at) AS unit FROM ranked),
targets AS (
  SELECT source, source_size, CASE WHEN unit IS NULL OR unit * w > 2.0 * source_size THEN 2.0 * source_size ELSE unit * w END AS target FROM weighted, level
), planned AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 2) END AS copies FROM targets
), units AS (
  SELECT source, h, sum(size) AS n FROM sized WHERE size > 0 GROUP BY source, h
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) - n AS before FROM units
)
SELECT s.doc_id, s.size, p.source_size, CAST(p.target AS DOUBLE) AS target,
       CAST(s.size * (p.copies + CASE WHEN coalesce(u.before + u.n / 2.0 <= p.target - p.copies * p.source_size AND p.target - p.copies * p.source_size > 0, false) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
LEFT JOIN summed u ON u.source IS NOT DISTINCT FROM s.source AND u.h = s.h AND s.size > 0
"""

OP3_JACCARD_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM inter JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS seen FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.seen)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(c, d.doc_id) AS BIGINT) AS component_id, CAST(coalesce(l, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(seen) AS c FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id
LEFT JOIN (SELECT a AS doc_id, count(*) AS l FROM both_ways GROUP BY a) k ON k.doc_id = d.doc_id
"""

ORACLES: dict[str, str] = {"op3_jaccard_join": OP3_JACCARD_JOIN, "op7_mixing": OP7_MIXING}
