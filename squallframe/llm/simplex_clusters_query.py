"""Query ``op12_simplex_clusters`` and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .simplex_clusters import clusters, integer_vectors

NAME = "op12_simplex_clusters"
WIDTH, SCALE, CENTROIDS, ROUNDS = 64, 64.0, 16, 3


def clustered(embeddings: DataFrame) -> DataFrame:
    """Centroids start at the vectors of the smallest sha256 of ``1:<vec_id>``."""
    name = F.concat(F.lit("1:"), F.col("vec_id").cast("string"))
    return clusters(integer_vectors(embeddings, WIDTH, SCALE), CENTROIDS, ROUNDS, F.sha2(name.cast("binary"), 256))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{folder}/embeddings.parquet"))


def _round(i: int) -> str:
    """One round in SQL: assign to ``c{i - 1}``, then move the centroids to ``c{i}``."""
    return f"""
a{i} AS MATERIALIZED (
  SELECT vec_id, any_value(v.v) AS v, min({{'d': list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.c}}) AS best
  FROM v, c{i - 1} c GROUP BY vec_id
), s{i} AS (
  SELECT best.c AS c, i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY ALL
), m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{i} GROUP BY c),
c{i} AS MATERIALIZED (SELECT p.c, coalesce(m{i}.v, p.v) AS v FROM c{i - 1} p LEFT JOIN m{i} USING (c)),"""


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM v QUALIFY c < {CENTROIDS}
),{"".join(_round(i + 1) for i in range(ROUNDS))}
told AS (
  SELECT vec_id, min({{'d': list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.c}}) AS best
  FROM v, c{ROUNDS} c GROUP BY vec_id
)
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM told JOIN c{ROUNDS} ON c{ROUNDS}.c = told.best.c
"""
