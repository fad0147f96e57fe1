"""Query ``op6_ngram_join`` and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .ngram_join import similarity_components

NAME = "op6_ngram_join"


def query(spark: SparkSession, folder: str) -> DataFrame:
    return similarity_components(spark.read.parquet(f"{folder}/documents.parquet"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), sized AS (SELECT doc_id, len(s)::BIGINT AS n, s FROM sets),
items AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (SELECT doc_id AS node, doc_id AS seen FROM sized UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON r.seen = p.a)
SELECT s.doc_id, s.n AS n_shingles, m.c AS component_id
FROM sized s JOIN (SELECT node, min(seen) AS c FROM reach GROUP BY node) m ON m.node = s.doc_id
"""
