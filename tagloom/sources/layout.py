"""Parquet layouts of the store.

``long`` holds one row per tag. It is split by ``tag_bucket``, a hash of namespace and
key, and sorted by namespace, key and value inside a file: a query that names both reads
one directory, and row group statistics narrow it further. The key itself isn't the
partition column, as partition values are guessed to be numbers (``01`` = ``1``) and an
empty one can't be told from NULL.

A key may hold a third of all rows, so rows of a bucket are spread over files by a salt
from the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.model import NESTED, TAGS

BUCKET = "tag_bucket"
_COUNT = "tag_bucket_count"


def _bucket(ns: Column, key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ns, key), F.lit(buckets)).cast("int")


def clustered(tags: DataFrame) -> bool:
    """Whether the rows come from the bucketed layout."""
    return BUCKET in tags.columns and _COUNT in tags.schema["key"].metadata


def bucket_of(tags: DataFrame, ns: str | None, key: str) -> Column:
    """The one bucket that can hold this namespace and key."""
    return _bucket(F.lit(ns).cast("string"), F.lit(key), tags.schema["key"].metadata[_COUNT])


def write_long(tags: DataFrame, path: str, buckets: int = 64, files_per_bucket: int = 8, mode: str = "error") -> None:
    """Choose the counts by the data: a file should come to some hundred MB, so 100 TB ask
    for some 500,000 files, such as 4,096 buckets of 128 files. The bucket count is kept in
    the files' own schema."""
    (
        tags.select(*TAGS.fieldNames())
        .withColumn(BUCKET, _bucket(F.col("ns"), F.col("key"), buckets))
        .withMetadata("key", {_COUNT: buckets})
        .repartition(buckets * files_per_bucket, BUCKET, F.pmod(F.xxhash64("id"), F.lit(files_per_bucket)))
        .sortWithinPartitions(BUCKET, "ns", "key", "value")
        .write.mode(mode)
        .partitionBy(BUCKET)
        .option("parquet.bloom.filter.enabled#id", "true")
        .parquet(path)
    )


def read_long(spark: SparkSession, path: str) -> DataFrame:
    """The long layout; queries with the posting plan prune it by bucket."""
    return spark.read.parquet(path)


def to_nested(tags: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One row per item with its tags; items adds ids without tags. A row holds all tags
    of one item, as the nested layout asks for."""
    nested = tags.groupBy("id").agg(F.collect_set(F.struct("ns", "key", "value")).alias("tags"))
    if items is None:
        return nested
    empty = F.array().cast(NESTED["tags"].dataType)
    return items.select("id").distinct().join(nested, "id", "left").select("id", F.coalesce("tags", empty).alias("tags"))


def to_long(nested: DataFrame) -> DataFrame:
    """Distinct tags of nested items; an item without tags gives no row."""
    return nested.select("id", F.inline("tags")).select(*TAGS.fieldNames()).distinct()
