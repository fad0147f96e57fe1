"""Per-key building blocks that hold when one key owns a large share of the rows.

A plain window over a key sends the whole key to one task. The helpers here aggregate first
(map-side combine) and join the small result back, where adaptive execution can split the
hot key, or rank inside sub-buckets of a key and add the offset of the earlier buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet; the right side's key columns are dropped."""
    renamed = right.select(*[F.col(k).alias(f"__right_{k}") for k in keys],
                           *[F.col(c) for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__right_{k}"))
    return left.join(renamed, condition, how).drop(*[f"__right_{k}" for k in keys])


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of an aggregate without keys, which is always exactly one row."""
    return df.join(F.broadcast(one_row))


def with_group_values(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Aggregates of each row's group beside the row: partial aggregation, then a join back."""
    columns = [expr.alias(name) for name, expr in aggregates.items()]
    if not keys:
        return with_scalars(df, df.agg(*columns))
    return join_keys(df, df.groupBy(*keys).agg(*columns), keys)


def with_window_values(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """The same in one shuffle, for groups whose size the model bounds, such as the cells of a window."""
    group = Window.partitionBy(*keys)
    return df.withColumns({name: expr.over(group) for name, expr in aggregates.items()})


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
              out: str = "step") -> DataFrame:
    """1-based position of each row inside its key, in two levels.

    ``bucket`` must not decrease along ``order``; rows are ranked inside (key, bucket) and
    shifted by the row count of the key's earlier buckets. Only the bucket counts of a key
    meet in one task.
    """
    marked = df.withColumn("__bucket", bucket)
    parts = [*keys, "__bucket"]
    earlier = (Window.partitionBy(*keys).orderBy(F.col("__bucket").asc_nulls_first())
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (marked.groupBy(*parts).agg(F.count(F.lit(1)).alias("__n"))
               .withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
               .drop("__n"))
    inside = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
    ranked = marked.withColumn("__inside", inside)
    return (join_keys(ranked, offsets, parts)
            .withColumn(out, F.col("__inside") + F.col("__before"))
            .drop("__bucket", "__inside", "__before"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1,
                  rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key, whatever ``k``.

    Rows are ranked inside (key, hash of the row) first and the best ``k`` of each slot are ranked per
    key, so the rows of a hot key are spread over all tasks and at most ``k`` of a slot meet.
    Without keys the cut is a sort with a limit, which keeps ``k`` rows of every task.
    """
    name = rank or "__rank"
    if not keys:
        best = df.orderBy(*order).limit(k)
        return best.withColumn(name, F.row_number().over(Window.orderBy(*order))) if rank else best
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    slotted = df.withColumn("__slot", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in hashed]), F.lit(slots)))
    inside = Window.partitionBy(*keys, "__slot").orderBy(*order)
    best = slotted.withColumn("__inside", F.row_number().over(inside)).filter(F.col("__inside") <= k)
    kept = (best.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .filter(F.col(name) <= k).drop("__slot", "__inside"))
    return kept if rank else kept.drop(name)


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ascending ``order``: one partial aggregate, no window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*").select(*df.columns)


def hash_sample(df: DataFrame, keys: Sequence[str], identity: Sequence[str], n: int, seed: int) -> DataFrame:
    """Seeded sample of ``n`` rows per key: smallest digests of (seed, identity) win."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity]))
    return first_per_key(df.withColumn("__digest", digest), keys,
                         [F.col("__digest"), *[F.col(c) for c in identity]], n).drop("__digest")


def validated_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-to-one left join; a repeated or missing key on either side fails the job."""
    def unique(df: DataFrame, side: str) -> DataFrame:
        repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        broken = F.col("__n") > 1
        for k in keys:
            broken = broken | F.col(k).isNull()
        return (join_keys(df, repeated, keys)
                .filter(F.when(broken, F.raise_error(F.lit(f"{side} keys are not one-to-one")).cast("boolean"))
                        .otherwise(F.lit(True)))
                .drop("__n"))
    return unique(left, "left").join(unique(right, "right"), list(keys), "left")


def unmatched_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only, labelled with that side; a key with a NULL equals none.

    One aggregate over the keys of both sides, which are combined before the shuffle: a task holds one table of keys.
    """
    sides = [df.select(*keys, *[F.lit(s == side).alias(s) for s in ("__left", "__right")]) for df, side in ((left, "__left"), (right, "__right"))]
    found = sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.max("__left").alias("__left"), F.max("__right").alias("__right"))
    missing = reduce(or_, [F.col(k).isNull() for k in keys])
    alone = [F.when(F.col(own) & (~F.col(other) | missing), F.lit(name)) for own, other, name in (("__left", "__right", "left"), ("__right", "__left", "right"))]
    return found.select(*keys, F.explode(F.array_compact(F.array(*alone))).alias("only_in"))


def count_by(df: DataFrame, keys: Sequence[str], share: str | None = None) -> DataFrame:
    """Row count per key, optionally with its share of all rows."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if share is None:
        return counted
    total = counted.agg(F.sum("n").alias("__total"))
    return with_scalars(counted, total).withColumn(share, F.col("n") / F.col("__total")).drop("__total")


def per_year_and_all(df: DataFrame, year: str, *aggregates: Column) -> DataFrame:
    """Yearly rows plus one labelled ALL; rates are recomputed from the sums."""
    label = F.when(F.grouping(year) == 1, F.lit("ALL")).otherwise(F.col(year).cast("string"))
    return df.rollup(year).agg(label.alias("year_label"), *aggregates).drop(year)
