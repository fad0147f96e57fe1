"""Writers: idempotent partitions, stage enrichment and layer replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.missing import WINDOW_FILL, with_fill


def write_table(df: DataFrame, path: str, fmt: str = "parquet", header: bool = True) -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", header).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def save_table(df: DataFrame, table: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """The rows as a table of the warehouse in a file format (csv, json, parquet), and the table read back."""
    df.write.mode("overwrite").format(fmt).options(**options).saveAsTable(table)
    return df.sparkSession.table(table)


def write_manifest(df: DataFrame, path: str) -> None:
    """Run facts as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_partitions(df: DataFrame, path: str, by: Sequence[str], sort: Sequence[str] = ()) -> None:
    """Overwrite only the partitions present in ``df``; one shuffle on the partition columns and
    the sort key's leading column keeps hot partitions spread over several files."""
    spread = df.repartition(*by, *sort[:1])
    if sort:
        spread = spread.sortWithinPartitions(*by, *sort)
    (spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").partitionBy(*by).parquet(path))


def write_tiles(tiles: DataFrame, table: str, buckets: int, by: Sequence[str] = ()) -> DataFrame:
    """A layer's tiles as a table bucketed and sorted by its tile keys; joins on all of them shuffle nothing.

    Layers that are to be stacked share ``buckets`` and ``by``; with fewer buckets than shuffle partitions Spark may
    prefer to deal a layer anew when other rows are sent to it. Nothing moves here: ``to_tiles`` with the same
    ``buckets`` has dealt the cells, so that a task writes one bucket.
    """
    keys = [*by, "tile_row", "tile_col"]
    (tiles.write.mode("overwrite").option("compression", "zstd")
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))
    return tiles.sparkSession.table(table)


def write_by_key(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """A stage table bucketed and sorted by its keys: later steps by these keys read it where it lies."""
    df.write.mode("overwrite").option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def write_observed(df: DataFrame, table: str, counters: dict[str, Column]) -> dict:
    """Write a table and count on the way: the counters are aggregates over the rows as they pass to the writer.

    They cost no pass of their own. Like any observed metric they may count a task twice if its stage is run
    again after it had finished.
    """
    seen = Observation(f"write {table}")
    df.observe(seen, *[c.alias(name) for name, c in counters.items()]).write.mode("overwrite").option("compression", "zstd").saveAsTable(table)
    return seen.get


def pending(planned: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work whose output does not exist yet."""
    return planned.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def enrich(stage: DataFrame, extra: DataFrame, keys: Sequence[str], columns: Sequence[str],
           overwrite: bool = False) -> DataFrame:
    """Previous stage plus new variables; a variable that exists already is an error."""
    clash = [c for c in columns if c in stage.columns]
    if clash and not overwrite:
        raise ValueError(f"variables already present: {clash}")
    return stage.drop(*clash).join(extra.select(*keys, *columns), list(keys), "left")


def replace_variables(stage: DataFrame, old: Sequence[str], fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Everything but the old variables, with the new ones joined on."""
    return stage.drop(*old).join(fresh, list(keys), "left")


def limit_groups(df: DataFrame, group: str, pattern: str | None = None, limit: int | None = None) -> DataFrame:
    """Groups whose name fits, and of those the first ``limit`` by name (trial runs)."""
    if pattern is not None:
        df = df.filter(F.col(group).cast("string").rlike(pattern))
    if limit is not None:
        names = df.select(group).distinct().orderBy(group).limit(limit)
        df = df.join(names, group, "left_semi")
    return df


def packed_windows(cells: DataFrame, keys: Sequence[str], value: str, size: int = 41) -> DataFrame:
    """Dense float array per window for array stores; missing cells carry the sentinel."""
    slot = F.struct((F.col("wi") * size + F.col("wj")).alias("i"), with_fill(F.col(value), WINDOW_FILL).cast("float").alias("v"))
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(slot)), lambda s: s["v"]).alias(value))


def plot_table(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The tidy, sorted table behind a figure."""
    return df.select(*columns).orderBy(*order)
