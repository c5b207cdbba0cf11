"""Query and DuckDB SQL of the spelling variants."""

from __future__ import annotations

from . import spelling
from .common import read_table
from .queries import register

#: The runs of one word in one document lose a letter if 97 divides their hash.  CRC-32 by its bitwise rule: eight shifts (-1) after each byte.
DAMAGE = 97
SQL = r"""
WITH RECURSIVE
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents),
own AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM runs WHERE length(w) >= 5 GROUP BY ALL),
hashed AS (
  SELECT w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM own),
crc AS (
  SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(0, length(x) // 2),
               lambda i: [CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) AS h
  FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM crc)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM words, range(0, length(word)) t(i)),
near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM words)),
best AS (
  SELECT near.word, count(*) AS n_near, first(o.word ORDER BY o.n DESC, o.word) AS form, max(o.n) AS form_n
  FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form END AS form,
         CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain AS (
  SELECT word, word AS last, 0 AS step FROM forms
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM forms f JOIN (SELECT word, arg_max(last, step) AS root FROM chain GROUP BY word) r USING (word)
"""


@register("op13_spelling_variants", SQL)
def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(spelling.word_counts(read_table(spark, sf_dir, "documents"), DAMAGE))
