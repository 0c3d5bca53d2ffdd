"""Per-key results when a few keys hold most rows, by exact offset chunking.

For every name of each grain: its rows, distinct ids and distinct values.

1. Rows are folded where they are read, to one per (namespace, key, member) of a batch.
2. The folded rows are lined up across partitions in two orders: by (key, kind, member,
   namespace), which serves keys and attributes alike, and by (namespace, kind, member). A large
   key lies in many adjacent partitions.
3. The rows of each partition are counted; prefix sums of the counts give each partition's
   offset, and so every row its number in the whole line.
4. The line is cut at equal offsets, wherever partitions end. A key's rows in one such chunk
   become a small state: rows, distinct members, first and last member.
5. A key's states merge in the order of their rows: a member that ends one chunk and begins
   the next was counted twice.

No task meets a whole large key, and what is merged is one state per key and chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.checkpoints import saved
from tagloom.sizing import by_range

#: Folded rows of one chunk.
CHUNK = 250_000
GRAINS = ("ns", "key", "attr")
#: The two orders.
_BY_KEY, _BY_NS = 0, 1
_IDS, _VALUES = 0, 1
_AT = 6
_LINE = "line int, name string, kind int, member string, ns string, n bigint"
_STATE = "grain string, ns string, name string, kind int, at bigint, n_rows bigint, members bigint, first string, last string"
_MERGED = "grain string, ns string, name string, n_rows bigint, n_ids bigint, n_values bigint"
_STATE_TYPES = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
#: Most rows and bytes gathered before they are folded, or made a state.
HOLD, HOLD_BYTES = 500_000, 64 << 20


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def grain_name(grain: str, ns: Column, key: Column) -> Column:
    """``-`` for an absent namespace; ``ns:key``, or ``key`` alone."""
    if grain == "ns":
        return F.coalesce(ns, F.lit("-"))
    return key if grain == "key" else F.when(ns.isNull(), key).otherwise(F.concat(ns, F.lit(":"), key))


def _is_much(held: list[pa.RecordBatch]) -> bool:
    return sum(b.num_rows for b in held) >= HOLD or sum(b.nbytes for b in held) >= HOLD_BYTES


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ns, key, id, value) to the rows of both orders. What is repeated among the rows
    at hand is one row with its count; the merge takes care of what is repeated beyond."""

    def folded(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for kind, member in ((_IDS, "id"), (_VALUES, "value")):
            own = rows.select(["ns", "key", member]).rename_columns(["ns", "key", "member"])
            if kind == _VALUES:
                own = own.filter(pc.is_valid(own["member"]))
            per = own.group_by(["ns", "key", "member"]).aggregate([([], "count_all")]).rename_columns(["ns", "key", "member", "n"])
            for line in (_BY_KEY, _BY_NS):
                if line == _BY_KEY:
                    out = per.filter(pc.is_valid(per["key"]))
                    name, ns = out["key"], out["ns"]
                else:
                    spelled = per.set_column(0, "ns", pc.fill_null(per["ns"], "-"))
                    out = spelled.group_by(["ns", "member"]).aggregate([("n", "sum")]).rename_columns(["ns", "member", "n"])
                    name, ns = out["ns"], pa.nulls(len(out), pa.string())
                size = len(out)
                columns = [pa.array(np.full(size, line, np.int32)), name, pa.array(np.full(size, kind, np.int32)), out["member"], ns, out["n"]]
                yield from pa.table(columns, names=_names(_LINE)).combine_chunks().to_batches(max_chunksize=50_000)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if _is_much(held):
            yield from folded(pa.Table.from_batches(held))
            held = []
    if held:
        yield from folded(pa.Table.from_batches(held))


def lined_up(writes: DataFrame) -> DataFrame:
    """The folded rows in both orders with ``at``, their number in the whole line."""
    order = ["line", "name", "kind", "member", "ns"]
    folded = saved(writes.select("ns", "key", "id", "value").mapInArrow(_fold, _LINE))
    # The number holds the partition and the row's place in it.
    line = saved(by_range(folded, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    counts = line.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # One number per partition.
    numbered = line.join(F.broadcast(offsets), part == F.col("part"))
    return numbered.select(*order, "n", (F.col("offset") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("at"))


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each row but the first differs from the one before; NULL equals NULL."""
    a, b = column[1:], column[:-1]
    unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return unlike | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))


def _chunk_states(chunk: int):
    """Numbered rows to the states of each chunk's keys. Rows come in runs of neighbours; how
    runs are spread over tasks and batches doesn't matter."""

    def states(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        size = len(rows)
        column = {c: rows[c].combine_chunks() for c in rows.column_names}
        at, n = column["at"].to_numpy(), column["n"].to_numpy()
        line, kind = column["line"].to_numpy(), column["kind"].to_numpy()
        valid = pc.is_valid(column["member"]).to_numpy(zero_copy_only=False)
        first = np.zeros(size, bool)
        first[0] = True
        name = first.copy()
        name[1:] = (at[1:] != at[:-1] + 1) | (at[1:] // chunk != at[:-1] // chunk) | (line[1:] != line[:-1]) | (kind[1:] != kind[:-1]) | _differs(column["name"])
        member = name.copy()
        member[1:] |= _differs(column["member"])
        whole = member.copy()
        whole[1:] |= _differs(column["ns"])
        starts = np.flatnonzero(name)
        ends = np.append(starts[1:], size) - 1
        piece = np.cumsum(name) - 1

        def out(grain: pa.Array, ns: pa.Array, who: np.ndarray, n_rows: np.ndarray, members: np.ndarray, head: pa.Array, tail: pa.Array) -> pa.RecordBatch:
            take = pa.array(starts[who])
            columns = [grain, ns, column["name"].take(take), pa.array(kind[starts[who]].astype(np.int32)), pa.array(at[starts[who]]), pa.array(n_rows), pa.array(members), head, tail]
            return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _STATE_TYPES, strict=True)], _names(_STATE))

        each = np.arange(len(starts))
        head, tail = column["member"].take(pa.array(starts)), column["member"].take(pa.array(ends))
        grain = pc.if_else(pa.array(line[starts] == _BY_KEY), "key", "ns")
        yield out(grain, pa.nulls(len(starts), pa.string()), each, np.bincount(piece, n).astype(np.int64), np.bincount(piece, member & valid).astype(np.int64), head, tail)
        # Attributes: the namespaces of each piece in the order by key.
        mine = np.flatnonzero(line == _BY_KEY)
        if not len(mine):
            return
        coded = pc.fill_null(column["ns"].dictionary_encode().indices, -1).to_numpy().astype(np.int64)
        names = column["ns"].dictionary_encode().dictionary
        spots, which = np.unique(piece[mine] * (len(names) + 1) + coded[mine] + 1, return_inverse=True)
        who, code = spots // (len(names) + 1), spots % (len(names) + 1) - 1
        ns = names.take(pa.array(np.where(code < 0, None, code).tolist(), pa.int64()))
        begins, closes = coded[starts[who]] == code, coded[ends[who]] == code
        nothing = pa.scalar(None, pa.string())
        yield out(
            pa.array(["attr"] * len(who)), ns, who, np.bincount(which, n[mine]).astype(np.int64), np.bincount(which, (whole & valid)[mine]).astype(np.int64),
            pc.if_else(pa.array(begins), head.take(pa.array(who)), nothing), pc.if_else(pa.array(closes), tail.take(pa.array(who)), nothing),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = batch.column(_AT).to_numpy()
            cuts = np.flatnonzero((at[1:] != at[:-1] + 1) | (at[1:] // chunk != at[:-1] // chunk)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                if held and (_is_much(held) or a or at[0] % chunk == 0):
                    yield from states(pa.Table.from_batches(held))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from states(pa.Table.from_batches(held))

    return run


def chunk_states(writes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One state per key, kind, chunk and run of neighbouring rows; ``at`` is the number of the
    run's first row. At grain ``attr`` name is the key, and first and last are NULL unless the
    run begins and ends with a row of this namespace."""
    return lined_up(writes).mapInArrow(_chunk_states(chunk), _STATE)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States in the order of (grain, ns, name, kind, at) to one row per key."""
    key, kind, last = None, None, None
    total = [0, 0, 0]
    done: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [[]] * 6
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.string()] * 3, *[pa.int64()] * 3], strict=True)], _names(_MERGED))

    for batch in batches:
        for grain, ns, name, of, _, n_rows, members, first, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (grain, ns, name) != key:
                if key is not None:
                    done.append((*key, *total))
                key, kind, total = (grain, ns, name), None, [0, 0, 0]
            if of != kind:
                kind, last = of, None
            if kind == _IDS:
                total[0] += n_rows
            total[1 + kind] += members - (first is not None and first == last)
            last = end
        if len(done) > 10_000:
            yield flush()
    if key is not None:
        done.append((*key, *total))
    yield flush()


def merged(writes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(grain, ns, name, n_rows, n_ids, n_values)``; at grain ``attr`` of every namespace and key."""
    key = ["grain", "ns", "name"]
    states = chunk_states(writes, chunk).repartition(*key).sortWithinPartitions(*key, "kind", "at")
    spelled = F.when(F.col("grain") == "attr", grain_name("attr", F.col("ns"), F.col("name"))).otherwise(F.col("name"))
    return states.mapInArrow(_merge, _MERGED).select("grain", "ns", F.col("name").alias("key"), spelled.alias("name"), "n_rows", "n_ids", "n_values")


def key_profile(writes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(grain, name, n_rows, n_ids, n_values)`` of every name at every grain.

    Rows delivered twice count twice. A NULL id or value adds a row but no distinct
    member; ``''`` is a value. A row without key counts at grain ``ns`` only. Names that
    look alike are one name, whose distinct members are counted anew from its own rows. An
    empty table gives no rows; extra columns are ignored.
    """
    own = writes.select("ns", "key", "id", "value")
    each = saved(merged(own, chunk))
    counts = ["n_rows", "n_ids", "n_values"]
    alike = saved(each.filter("grain = 'attr'").groupBy("name").agg(F.count("*").alias("c"), F.sum("n_rows").alias("n_rows")).filter("c > 1"))
    plain = each.join(alike.select("name", F.lit("attr").alias("grain")), ["grain", "name"], "left_anti").select("grain", "name", *counts)
    spelled = own.withColumn("name", grain_name("attr", F.col("ns"), F.col("key"))).join(alike.select("name"), "name", "left_semi")
    member = lambda c: spelled.select("name", c).filter(F.col(c).isNotNull()).distinct().groupBy("name").agg(F.count("*").alias(f"n_{c}s"))
    again = alike.join(member("id"), "name", "left").join(member("value"), "name", "left")
    return plain.unionByName(again.select(F.lit("attr").alias("grain"), "name", "n_rows", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts[1:]]))


def hot_keys(writes: DataFrame, percent: int = 6) -> DataFrame:
    """``(grain, name)`` of the names with at least this part of all rows, in whole numbers."""
    total = writes.agg(F.count("*").alias("n"))
    rows = merged(writes).groupBy("grain", "name").agg(F.sum("n_rows").alias("n_rows"))
    return rows.filter(F.col("n_rows") * 100 >= total.scalar() * percent).select("grain", "name")
