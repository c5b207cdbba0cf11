"""Query and DuckDB SQL of the mixing operator."""

from __future__ import annotations

from . import mixing
from .common import read_table
from .queries import register

SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS skey,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
c AS (
  SELECT *, CASE WHEN size < 64 THEN size
            ELSE 64 * (length(bin(size)) - 1) + (size >> (length(bin(size)) - 7)) - 64 END AS cls FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY cls, h, doc_id, size) AS pos FROM c),
s AS (SELECT skey, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w),
t AS (
  SELECT skey, source_size,
         CASE WHEN cap / w < level THEN CAST(cap AS DOUBLE)
              ELSE (SELECT max(level) FROM l WHERE NOT cap / w < level) * w END AS target,
         cap / w < level AS capped,
         CAST('0x' || substr(md5('mix-1|offset|' || skey), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS off
  FROM l),
p AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, t.off, r.pos,
         CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE WHEN capped THEN 3.0::DOUBLE ELSE t.target / t.source_size END AS rate
  FROM r JOIN t USING (skey))
SELECT doc_id, size, source_size, target,
       CAST(floor(rate * pos + off) - floor(rate * (pos - 1) + off) AS BIGINT) * size AS taken
FROM p
"""


@register("op4_mix_sources", SQL)
def op4_mix_sources(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
