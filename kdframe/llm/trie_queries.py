"""Query and DuckDB SQL of the conversation prefix trie."""

from __future__ import annotations

from . import trie
from .common import read_table
from .queries import register

#: CRC-32 by its bitwise rule: after each byte eight shifts (-1), with the reflected polynomial where the low bit is set.
SQL = r"""
WITH
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS lead,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
               lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.lead AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
steps AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(role) || md5(text), '') OVER w AS path,
         CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
places AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS words FROM convs UNION ALL SELECT conv_id, depth, path, words FROM steps),
last AS (SELECT conv_id, max(depth) AS depth FROM places GROUP BY conv_id),
nodes AS (SELECT path, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs FROM places GROUP BY path),
ends AS (SELECT path, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS sha FROM places p JOIN last USING (conv_id, depth) GROUP BY path),
kids AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
up AS (
  SELECT n.path AS below, a.path, (n.n_convs - 1) * n.words AS saved, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf
  FROM nodes n LEFT JOIN kids k ON k.path = n.path, range(0, n.depth + 1) r(d), nodes a WHERE a.path = left(n.path, CAST(64 * r.d AS BIGINT))),
sums AS (SELECT path, CAST(sum(saved) AS BIGINT) AS saved, CAST(sum(leaf) AS BIGINT) AS leaves FROM up GROUP BY path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
       CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens,
       coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 64)
LEFT JOIN kids k ON k.path = n.path LEFT JOIN ends e ON e.path = n.path JOIN sums s ON s.path = n.path
"""


@register("op11_conversation_trie", SQL)
def op11_conversation_trie(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations")
    return trie.prefix_trie(trie.with_heads(trie.sequences(turns)))
