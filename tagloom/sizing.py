"""How many partitions rows should be lined up in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

#: Bytes of a range partition, as far as Spark knows the size of what it partitions.
PARTITION_BYTES = 128 << 20
#: A size from which on Spark says that it knows none.
UNKNOWN = 1 << 60


def partitions_for(df: DataFrame, bytes_each: int = PARTITION_BYTES) -> int | None:
    """As many partitions as the size of df (a table's, or what is taken from one) asks for, if those are more than the session's
    ``spark.sql.shuffle.partitions``; else None, and adaptive execution may take fewer."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    asked = 0 if size >= UNKNOWN else -(-size // bytes_each)
    return asked if asked > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def by_range(df: DataFrame, *order: str | Column) -> DataFrame:
    """df in ranges of this order, in as many partitions as its size asks for: a range can't be
    split later, however large it turns out."""
    n = partitions_for(df)
    return df.repartitionByRange(*order) if n is None else df.repartitionByRange(n, *order)
