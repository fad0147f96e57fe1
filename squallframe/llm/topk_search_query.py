"""Query ``op8_topk_search`` and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .topk_search import integer_vectors, top_k

NAME = "op8_topk_search"


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 50, candidates all rows."""
    vectors = integer_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return top_k(vectors, vectors.filter(F.pmod("vec_id", F.lit(50)) == 0), k=5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), flat AS (
  SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM flat q JOIN flat c ON q.i = c.i AND q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
