"""SQL twin of the mixing query."""

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all("text", '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || CAST(doc_id AS VARCHAR)) AS digest
  FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([5.0, 2.0, 1.0][CAST((source_rank - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget, source_size * CAST(2.0 AS DOUBLE) AS cap
  FROM by_source),
levelled AS (
  SELECT *, (budget - coalesce(CAST(sum(cap) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_rank, source_size, budget,
         CASE WHEN level * weight >= cap THEN cap
              ELSE (budget - coalesce(sum(CASE WHEN level * weight >= cap THEN cap END) OVER (), 0.0))
                   / sum(CASE WHEN level * weight < cap THEN weight END) OVER () * weight END AS target
  FROM levelled),
placed AS (
  SELECT s.doc_id, s.size, s.digest, t.source_rank, t.source_size, t.target, t.budget,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS served
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, (served + source_size * n) / target AS finish, n FROM placed, (VALUES (0), (1)) AS c(n) WHERE size > 0),
totals AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_rank, digest, doc_id, size, n ROWS UNBOUNDED PRECEDING) AS total FROM copies),
kept AS (
  SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM totals WHERE total <= budget GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(k.taken, 0) AS taken, p.served / nullif(p.target, 0.0) AS virtual_finish
FROM placed p LEFT JOIN kept k USING (doc_id)
"""
