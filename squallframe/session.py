"""Session settings the operators are tuned for."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",  # rows that hold whole tiles
}


def build_session(app: str = "squallframe", master: str | None = None,
                  shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Create (or get) a session with the settings above; the cluster's own win for the rest."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for checkpoints, if any."""
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)


def cut_lineage(df: DataFrame, fallback: str | None = None) -> DataFrame:
    """Reliable checkpoint, which survives the loss of executors.

    ``fallback`` is a folder to use where the cluster names none, as in tests.
    """
    context = df.sparkSession.sparkContext
    folder = checkpoint_folder(df.sparkSession) or fallback
    if folder is None:
        raise ValueError("no checkpoint folder: set spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def reuse(df: DataFrame) -> DataFrame:
    """A frame several branches read, cached on disk at its first use; lost blocks are computed again.

    Nothing runs before the caller's first action. The caller releases it with ``unpersist``.
    """
    return df.persist(StorageLevel.DISK_ONLY)
