"""How often every term occurs, and in how many records.

Rows are lined up by term, record and write across range partitions, and one pass over each
partition keeps *last seen* counters: a row is a new occurrence if its write differs from the
row before, and a new record if its record does. No set of records is kept. A term that holds
a third of all rows, or a record that does, lies in as many neighbouring partitions as its rows
fill, so no task meets it whole; where a term goes on in the next partition, the last record
seen tells whether the first one there was counted before.

Of namespaces, keys and values on their own the occurrences are sums over tags. Their records
are counted in the same way, from rows folded to one per (part, record) where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.checkpoints import saved
from tagloom.sizing import by_range

TAG = ["ns", "key", "value"]
PART = ["grain", "term"]
_COUNTS = "part int, piece int, occurrences bigint, records bigint, head string, last string"
#: Most rows and bytes folded at once.
HOLD, HOLD_BYTES = 500_000, 64 << 20


def _unlike(column: pa.Array, before: pa.Array) -> np.ndarray:
    """Whether each row differs from the one before; before: the last row of the batch before, or
    an empty array, which every row differs from. NULL equals NULL."""
    if not len(before):
        return np.concatenate([[True], _unlike(column[1:], column[:1])]) if len(column) > 1 else np.ones(len(column), bool)
    a, b = column, pa.concat_arrays([before, column[:-1]])
    unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return unlike | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))


def _last_seen(width: int):
    """Ordered rows (term, id, write), a term being ``width`` columns, to counters of every
    term in the partition. A partition's first row counts as a new record; ``head`` is its id,
    and ``last`` the id that the batch ends with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece = TaskContext.get().partitionId(), 0
        before: list[pa.Array] | None = None
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            columns = batch.columns
            unlike = [_unlike(c, c[:0] if before is None else b) for c, b in zip(columns, before or columns, strict=True)]
            term = np.logical_or.reduce(unlike[:width])
            record = term | unlike[width]
            write = record
            for c, differs in zip(columns[width + 1 :], unlike[width + 1 :], strict=True):
                write = write | differs | ~pc.is_valid(c).to_numpy(zero_copy_only=False)
            named = pc.is_valid(columns[width]).to_numpy(zero_copy_only=False)
            term[0] = True  # a piece begins with every batch
            starts = np.flatnonzero(term)
            add = lambda x: pa.array(np.add.reduceat(x.astype(np.int64), starts))  # noqa: E731, B023
            head, last = [None] * len(starts), [None] * len(starts)
            if before is None:
                head[0] = columns[width][0].as_py()
            last[-1] = columns[width][-1].as_py()
            own = [c.take(pa.array(starts)) for c in columns[:width]]
            counts = [pa.array(np.full(len(starts), part, np.int32)), pa.array(np.full(len(starts), piece, np.int32)), add(write), add(record & named)]
            yield pa.RecordBatch.from_arrays([*own, *counts, pa.array(head, pa.string()), pa.array(last, pa.string())], [*batch.schema.names[:width], *[c.split()[0] for c in _COUNTS.split(", ")]])
            before, piece = [c[-1:] for c in columns], piece + 1

    return run


def lined_up(rows: DataFrame, term: list[str], write: tuple[str, ...] = ("seq", "pos")) -> DataFrame:
    """Rows in an order of term, record and write across partitions. Rows that can't be told
    apart have numbers of their own, so that they can part too. Terms and records are ordered
    by their hashes first, which compare faster than texts and aren't shuffled."""
    order = [*term, "id", *write]
    by = [F.xxhash64(*term), F.xxhash64("id")]
    if write:
        unknown = F.col(write[0]).isNull() | F.col(write[1]).isNull()
        rows = rows.select(*order, F.when(unknown, F.monotonically_increasing_id()).alias("lone"))
    line = by_range(rows, *by, *rows.columns)
    return line.select(*order, by[0].alias("by_term"), by[1].alias("by_id")).sortWithinPartitions("by_term", "by_id", *order).select(*order)


def _counted(rows: DataFrame, term: list[str], write: tuple[str, ...] = ("seq", "pos")) -> DataFrame:
    """``(term, occurrences, records)`` of rows ``(term, id, *write)``."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in term)
    pieces = lined_up(rows, term, write).mapInArrow(_last_seen(len(term)), f"{kinds}, {_COUNTS}")
    seen = F.lag("last").over(Window.partitionBy(*term).orderBy("part", "piece"))
    counted_twice = F.coalesce(F.col("head") == seen, F.lit(False)).cast("bigint")
    merged = pieces.select(*term, "occurrences", (F.col("records") - counted_twice).alias("records"))
    return merged.groupBy(*term).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def tag_counts(writes: DataFrame) -> DataFrame:
    """``(ns, key, value, occurrences, records)`` of every distinct tag.

    A row delivered twice (same seq and pos) counts once; rows without seq or pos can't be
    told apart and count each. A NULL id is an occurrence on no record; rows without key
    are no tags.
    """
    return _counted(writes.filter(F.col("key").isNotNull()).select(*TAG, "id", "seq", "pos"), TAG)


def _folded_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ns, key, value, id) to (grain, term, id), each once among the rows at hand."""

    def folded(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        for grain in TAG:
            per = rows.select([grain, "id"]).filter(pc.is_valid(rows[grain])).group_by([grain, "id"]).aggregate([])
            yield from pa.table([pa.array([grain]).take(pa.array(np.zeros(len(per), np.int64))), per[grain], per["id"]], names=[*PART, "id"]).combine_chunks().to_batches(max_chunksize=50_000)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= HOLD or sum(b.nbytes for b in held) >= HOLD_BYTES:
            yield from folded(held)
            held = []
    if held:
        yield from folded(held)


def part_counts(writes: DataFrame, tags: DataFrame) -> DataFrame:
    """``(grain, term, occurrences, records)`` of every namespace, key and value present; tags
    are the counts of the tags."""
    named = writes.filter(F.col("key").isNotNull() & F.col("id").isNotNull()).select(*TAG, "id")
    folded = saved(named.mapInArrow(_folded_parts, "grain string, term string, id string"))
    nothing = F.lit(None).cast("bigint")
    records = _counted(folded, PART, ()).select(*PART, nothing.alias("occurrences"), "records")
    parts = F.inline(F.array(*[F.struct(F.lit(c).alias("grain"), F.col(c).alias("term")) for c in TAG]))
    sums = tags.select("occurrences", parts).filter(F.col("term").isNotNull()).select(*PART, "occurrences", nothing.alias("records"))
    both = sums.unionByName(records).groupBy(*PART)
    return both.agg(F.sum("occurrences").alias("occurrences"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"))


def tag_text(ns: Column, key: Column, value: Column) -> Column:
    """``ns:key=value`` without quotes, absent parts left out."""
    return F.concat(F.coalesce(F.concat(ns, F.lit(":")), F.lit("")), key, F.coalesce(F.concat(F.lit("="), value), F.lit("")))


def mark_of(n_ids: Column, rare_below: int = 3, common_percent: int = 8) -> Column:
    """rare, common or NULL; rare wins in a collection so small that both hold."""
    return F.when(F.col("occurrences") < rare_below, "rare").when(F.col("records") * 100 > n_ids * common_percent, "common")


def distinct_ids(writes: DataFrame) -> Column:
    return writes.agg(F.count_distinct("id").alias("n")).scalar()


def marked_tags(writes: DataFrame, rare_below: int = 3, common_percent: int = 8) -> DataFrame:
    """``(term, mark)`` of the tags too rare or too common to be useful."""
    marked = tag_counts(writes).withColumn("mark", mark_of(distinct_ids(writes), rare_below, common_percent))
    return marked.filter(F.col("mark").isNotNull()).select(tag_text(*map(F.col, TAG)).alias("term"), "mark")


def all_terms(writes: DataFrame) -> DataFrame:
    """``(grain, term, occurrences, records, mark)`` of tags and of their parts. Parts have
    no mark. An empty table gives no rows."""
    tags = saved(tag_counts(writes))
    whole = tags.select(
        F.lit("tag").alias("grain"), tag_text(*map(F.col, TAG)).alias("term"), "occurrences", "records", mark_of(distinct_ids(writes)).alias("mark")
    )
    return whole.unionByName(part_counts(writes, tags).withColumn("mark", F.lit(None).cast("string")))
