"""The store as a stream: lines or writes come in, the log grows, standing queries follow.

Writes carry their own order (``seq``, ``pos``), so late rows need no watermark: what a
late write means is decided by its number, not by when it arrives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagloom.config import ROOT_NS, arity_ns, hide_ns, type_ns
from tagloom.model import WRITES
from tagloom.operators.collapse import small_targets
from tagloom.sources.lines import parse_lines, to_writes
from tagloom.store import TagStore

#: Groups of ids the log of a standing query is split by.
GROUPS = 64
_LOG = "seq bigint, pos int, id string, ns string, key string, value string, batch bigint, id_group int"


def writes_of(lines: DataFrame, mode: str = "dropmalformed") -> DataFrame:
    """The writes of a stream of ``(seq, value)`` lines; stateless."""
    return to_writes(parse_lines(lines, mode))


def append_log(writes: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of writes to a Parquet log, exactly once per row delivered. Rows
    delivered twice by the source stay in the log and don't matter to any query."""
    out = writes.select(*WRITES.fieldNames()).writeStream.format("parquet").outputMode("append")
    return out.option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_values(writes: DataFrame, log: DataFrame, root: str = ROOT_NS) -> DataFrame:
    """``(id, ns, key, value, seq)``: the value of every scalar key as the stream goes on, in
    update mode. Targets are those declared in ``log`` when the query starts. The state is
    one row per item and scalar key."""
    targets = small_targets(log, root)
    own = writes.select(*WRITES.fieldNames())
    if targets is None:
        targets = F.broadcast(writes.sparkSession.createDataFrame([], "t_ns string, t_key string, since bigint"))
    met = own.join(targets, F.col("ns").eqNullSafe(F.col("t_ns")) & (F.col("key") == F.col("t_key")))
    last = F.max(F.struct("seq", "pos", "value")).alias("last")
    return met.filter(F.col("seq") > F.col("since")).groupBy("id", "ns", "key").agg(last).select("id", "ns", "key", "last.value", "last.seq")


def _group() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(GROUPS)).cast("int")


def standing_query(
    writes: DataFrame, log_path: str, query: str, sink: Callable[[DataFrame, int], None], checkpoint: str,
    prepare: Callable[[TagStore], None] | None = None, root: str = ROOT_NS, **trigger,
) -> StreamingQuery:
    """Append each micro-batch to the log and give ``sink`` the whole new answer.

    Whether an item answers follows from its own writes and the settings. So a batch without
    settings asks only the items it touches, in their groups of the log, and takes all others
    from the last answer; a batch with settings asks the whole log anew. A batch and its
    answer are written under its number; one that is tried again after a failure replaces its
    own rows, and starts from the answer before it. Answers older than that are removed.
    """
    spark = writes.sparkSession
    log, answers = f"{log_path}/writes", f"{log_path}/answers"

    def on_batch(batch: DataFrame, number: int) -> None:
        rows = batch.select(*WRITES.fieldNames())
        rows.withColumn("id_group", _group()).write.mode("overwrite").partitionBy("id_group").parquet(f"{log}/batch={number}")
        new = spark.read.schema(rows.schema).parquet(f"{log}/batch={number}")
        settings = (hide_ns(root), arity_ns(root), type_ns(root))
        everything = spark.read.schema(_LOG).option("basePath", log).parquet(log)
        whole = not _exists(spark, f"{answers}/batch={number - 1}") or not new.filter(F.col("ns").isin(*settings)).isEmpty()
        touched = new.select("id").distinct()
        asked = everything if whole else everything.filter(F.col("id_group").isin([r[0] for r in touched.select(_group()).distinct().collect()])).join(touched, "id", "left_semi")
        # Settings come from the whole log: what declares a scalar key may be an old write.
        declared = everything.filter(F.col("ns").isin(*settings)) if not whole else None
        kept = asked if declared is None else asked.unionByName(declared.join(touched, "id", "left_anti"))
        store = TagStore.from_writes(kept.select(*WRITES.fieldNames()), root=root)
        if prepare is not None:
            prepare(store)
        answer = store.query(query, ordered=False)
        if not whole:
            answer = answer.join(touched, "id", "left_semi").union(spark.read.schema("id string").parquet(f"{answers}/batch={number - 1}").join(touched, "id", "left_anti"))
        answer.write.mode("overwrite").parquet(f"{answers}/batch={number}")
        _remove(spark, f"{answers}/batch={number - 2}")
        sink(spark.read.schema("id string").parquet(f"{answers}/batch={number}").orderBy("id"), number)

    out = writes.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    files, target = _path(spark, path)
    return files.exists(target)


def _remove(spark: SparkSession, path: str) -> None:
    files, target = _path(spark, path)
    files.delete(target, True)
