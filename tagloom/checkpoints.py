"""Cutting lineage where every executor can read it."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; only a local
    session that names none gets a temporary folder of its own."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tagloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, computed now."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: What the open scopes are to delete, the innermost last.
_scopes: list[list[tuple[SparkSession, str]]] = [[]]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may have ended before
        pass


def _close(tables: list[tuple[SparkSession, str]]) -> None:
    while tables:
        _delete(*tables.pop())


atexit.register(_close, _scopes[0])


@contextmanager
def scope() -> Iterator[None]:
    """Tables saved inside are deleted at its end, so results that need them must have been
    written by then. A long session over much data runs each operator in one.

    >>> with scope():
    ...     similar_pairs(tables).write.parquet(target)
    """
    _scopes.append([])
    try:
        yield
    finally:
        _close(_scopes.pop())


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new place in the shared folder, deleted when the scope around ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _scopes[-1].append((spark, path))
    return path


def saved(df: DataFrame) -> DataFrame:
    """The same rows from a compressed table in the shared folder, written now: smaller than a
    checkpoint, read by column, and of a size that Spark knows. It is deleted when the scope
    around it ends, without one when the driver does."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
