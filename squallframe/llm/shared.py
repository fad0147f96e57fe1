"""Small helpers the training-data operators share."""

from __future__ import annotations

import ctypes
import inspect
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("no shared folder: set spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def numbered(df: DataFrame) -> DataFrame:
    """The columns as c0, c1, ... so that no name an operator uses can clash with one of theirs; ``toDF`` gives the names back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the frame as a table in the shared folder and read it again.

    Unlike a cache it outlives lost executors, unlike ``checkpoint()`` it is compressed and
    later reads fetch only the columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what this Python worker has freed to the system: workers outlive their tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def giving_back(fn: Callable) -> Callable:
    """A task function (of batches, of a group or of two) that gives freed memory back after each result."""
    if inspect.isgeneratorfunction(fn):
        def wrapped(batches):
            for out in fn(batches):
                yield out
                del out
                give_back()
    elif len(inspect.signature(fn).parameters) == 1:
        def wrapped(part):
            out = fn(part)
            give_back()
            return out
    else:
        def wrapped(left, right):
            out = fn(left, right)
            give_back()
            return out
    return wrapped


def hash_slots(spark: SparkSession, per: int = 1) -> int:
    """As many groups as the session has shuffle partitions, times ``per``."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * per)


def whole_text(column: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def crc_fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(folds))
