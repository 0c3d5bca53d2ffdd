"""All pairs of records whose sets overlap enough: those that share a token which isn't
frequent by a prefix filter, the others by recursive chosen-path splitting.

A pair similar enough shares one of the first few tokens of both sets, in any fixed order. In
the order taken, tokens that aren't frequent come first, so a pair that shares one meets for
certain at such a token. What remains are pairs that share frequent tokens only. They exist
only among records with few other tokens, and only the frequent tokens of these go on: pairs
with few shared tokens meet for certain at the subset they share, all others in trees. A tree
sends a record down from its root: at each node the record follows those of its unused tokens
that a hash of (path, token) picks, each with probability ``branch / unused tokens``, so two
records that overlap much are likely to go on together, and other pairs part. A record goes
down as many trees as the worst pair of its size needs to meet with probability ``recall``.

Small nodes are compared in full, larger ones block by block; a tree's node that is larger
than ``whole`` is split again, as often as ``recall`` asks for, and what is still so large
after ``rounds`` is compared block by block too, so no node is capped. Candidates
whose sketches differ in more bits than all but ``missed`` of the similar pairs' are dropped,
every other one is verified on the whole sets.

Only (node, record, size, sketch) is shuffled, never the sets, and a record is named there
by a hash of its id: two ids of one hash only make a candidate more. Equal sets are folded
into one representative first, so a group of copies, however large, is one row in the trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce
from itertools import combinations
from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.checkpoints import saved

_ROWS = "place bigint, rep bigint, sketch bigint"
_FOUND = "kind int, a bigint, b bigint, node bigint, level int"
#: An odd number with its bits well mixed, to tell seeds and levels apart.
_DENSE = 0xD6E8FEB86659FD93
#: A row's place holds 48 bits of the node's hash, 4 of its level and 12 of the set's size.
#: Nodes of one hash are compared together, which costs a comparison and loses nothing;
#: sizes from 4,095 on count as that, which keeps every pair whose true sizes allow it.
_NODE, _SIZE = 16, 12
_MOST = (1 << _SIZE) - 1


@dataclass(frozen=True)
class Params:
    """threshold is the least Jaccard similarity, as a fraction num/den. recall: probability
    to meet of the worst pair that shares frequent tokens only; all others meet for certain.
    trees: least number of trees. exact: no trees and no sketches; pairs that share frequent
    tokens only meet at these, whose nodes are compared block by block: every pair is found, at
    a cost quadratic in the records of a frequent token."""

    num: int = 3
    den: int = 4
    least: int = 5
    trees: int = 12
    branch: float = 1.33
    depth: int = 6
    limit: int = 64
    frequent: int = 20_000
    rounds: int = 6
    block: int = 512
    recall: float = 0.99
    #: Most records of a tree's node that is compared without splitting it again.
    whole: int = 4_096
    #: Probability that a similar pair is dropped for its sketches, at most.
    missed: float = 1e-5
    #: Most subsets of one size that a record is put under.
    subsets: int = 64
    #: Most bytes of a side that is broadcast, measured; beyond, the join shuffles.
    broadcast_bytes: int = 48 << 20
    exact: bool = False


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: a bijection that spreads all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sketches(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 one-bit minhashes of each set: equal bits estimate (1 + Jaccard) / 2."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(64):
        least = np.minimum.reduceat(_mix(tokens + np.uint64((k + 1) * _DENSE % 2**64)), starts)
        out |= (least & np.uint64(1)) << np.uint64(k)
    return out


@cache
def sketch_bits(p: Params) -> int:
    """Bits that may differ between sketches of a similar pair: each differs with probability
    (1 - num / den) / 2, and more of 64 than these with ``missed`` at most."""
    q = (1 - p.num / p.den) / 2
    tail, bits = 0.0, 64
    while bits and not p.exact and (tail := tail + comb(64, bits) * q**bits * (1 - q) ** (64 - bits)) <= p.missed:
        bits -= 1
    return bits


SKETCH_BITS = sketch_bits(Params())


def longest(overlap: int, p: Params) -> int:
    """The largest set of a similar pair with this overlap."""
    return overlap * p.den // p.num


def prefix(n: np.ndarray, p: Params) -> np.ndarray:
    """Tokens of a set of n of which a similar pair shares one, in any order of tokens."""
    return n - -(-n * p.num // p.den) + 1


@cache
def certain(p: Params) -> int:
    """Pairs that overlap in at most so many tokens meet at the subset they share."""
    overlap = least_overlap(p) - 1
    while comb(longest(overlap + 1, p), overlap + 1) <= p.subsets:
        overlap += 1
    return overlap


def least_overlap(p: Params) -> int:
    return max(1, ceil(p.least * p.num / p.den))


@cache
def depth_of(p: Params) -> int:
    """Tokens on a tree's path: never more than the pairs left to the trees share."""
    return min(p.depth, certain(p) + 1)


def survival(overlap: int, size: int, p: Params) -> float:
    """Probability that two sets, the larger one of this size, end in one node of a tree."""
    alive = 1.0
    for used in reversed(range(depth_of(p))):
        alive = 1 - (1 - min(1.0, p.branch / (size - used)) * alive) ** (overlap - used)
    return alive


def repeats(alive: float, p: Params) -> int:
    return 1 if alive >= 1 else ceil(log(1 - p.recall) / log1p(-alive))


@cache
def trees_of(size: int, p: Params) -> int:
    """Trees for a set of so many frequent tokens, by the worst pair it can be in."""
    overlaps = range(max(certain(p) + 1, -(-size * p.num // p.den)), size + 1)
    return max((max(p.trees, repeats(survival(o, longest(o, p), p), p)) for o in overlaps), default=0)


@cache
def splits(p: Params) -> int:
    """Times a large node is split: a pair goes on together with 1 - 1/e**(branch * num / den)."""
    return repeats(1 - float(np.exp(-p.branch * p.num / p.den)), p)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def descend(tokens: np.ndarray, lengths: np.ndarray, roots: np.ndarray, owner: np.ndarray, level: int, depth: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(node, owner) of every path's end, ``depth`` tokens on. tokens: of all records, laid end
    to end; roots and owner: where each descent starts and of which record."""
    first = _starts(lengths)
    used = np.zeros((len(roots), 0), np.int64)
    node = roots
    for down in range(depth):
        count = lengths[owner]
        parent = np.repeat(np.arange(len(node)), count)
        at = np.arange(count.sum()) - np.repeat(_starts(count), count) + np.repeat(first[owner], count)
        mixed = _mix(node[parent] ^ _mix(tokens[at] + np.uint64((level + down + 1) * _DENSE % 2**64)))
        picked = (mixed >> np.uint64(11)).astype(np.float64) * 2.0**-53 * (count[parent] - down) < p.branch
        for k in range(down):
            picked &= used[parent, k] != at
        parent, at = parent[picked], at[picked]
        node, owner = _mix(mixed[picked] + np.uint64(1)), owner[parent]
        used = np.column_stack([used[parent], at])
    return node, owner


def subset_nodes(tokens: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, owner): the subsets of its tokens that a record of this size can share with a
    similar one, up to ``certain`` tokens."""
    first, mixed = _starts(lengths), _mix(tokens + np.uint64(_DENSE))
    for n, f in set(zip(sizes.tolist(), lengths.tolist(), strict=True)):
        who = np.flatnonzero((sizes == n) & (lengths == f))
        for size in range(1, min(f, certain(p)) + 1):
            if size * p.den >= (n + max(size, p.least) - size) * p.num:
                picks = np.array(list(combinations(range(f), size)))
                node = mixed[first[who][:, None, None] + picks[None]].sum(2, dtype=np.uint64)
                yield _mix(node + np.uint64(size)).ravel(), np.repeat(who, len(picks))


def pairs_in_runs(node: np.ndarray, n: np.ndarray, sketch: np.ndarray, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within runs of equal nodes whose sizes and sketches allow the threshold."""
    i = np.arange(len(node) - 1)
    step = 1
    while len(i):
        i = i[i + step < len(node)]
        i = i[node[i] == node[i + step]]
        j = i + step
        small, large = np.minimum(n[i], n[j]).astype(np.int64), np.maximum(n[i], n[j]).astype(np.int64)
        ok = (small * p.den >= large * p.num) & (np.bitwise_count(sketch[i] ^ sketch[j]) <= sketch_bits(p))
        yield i[ok], j[ok]
        step += 1


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), lengths


def _place(node: np.ndarray, level: int, sizes: np.ndarray) -> pa.Array:
    low = np.uint64(level << _SIZE) | np.minimum(sizes, _MOST).astype(np.uint64)
    return pa.array((node >> np.uint64(_NODE) << np.uint64(_NODE) | low).view(np.int64))


def _node_rows(batch: pa.RecordBatch, node: np.ndarray, level: int, sizes: np.ndarray, who: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
    place = _place(node, level, sizes[who])
    return pa.RecordBatch.from_arrays([place, batch.column(0).take(pa.array(who)), pa.array(sketch[who].view(np.int64))], names=["place", "rep", "sketch"])


def _only_frequent(tokens: np.ndarray, lengths: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are frequent, and how many of each record are."""
    often = np.isin(tokens, frequent) if len(frequent) else np.zeros(len(tokens), bool)
    return often, np.bincount(np.repeat(np.arange(len(lengths)), lengths)[often], minlength=len(lengths))


def _rows_from_top(frequent: np.ndarray, p: Params):
    """Node rows of record batches (rep, tokens). Level 0: nodes where pairs meet for certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = lambda t: _mix(np.array([t + 1], np.uint64) * np.uint64(_DENSE))
        with np.errstate(over="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                tokens, lengths = _lists(batch.column(1))
                sketch = sketches(tokens, _starts(lengths))
                often, many = _only_frequent(tokens, lengths, frequent)
                record = np.repeat(np.arange(len(lengths)), lengths)
                # Each set's tokens with the frequent ones last, and the first of these.
                order = np.lexsort((often, record))
                place = np.arange(len(tokens)) - np.repeat(_starts(lengths), lengths)
                kept = order[(place < prefix(lengths, p)[record]) & (p.exact | ~often[order])]
                yield _node_rows(batch, _mix(tokens[kept]), 0, lengths, record[kept], sketch)
                if p.exact:
                    continue
                # Records that may share frequent tokens only with a similar one.
                left = np.flatnonzero(lengths - many < prefix(lengths, p))
                tokens = tokens[often & np.isin(record, left)]
                for node, who in subset_nodes(tokens, many[left], lengths[left], p):
                    yield _node_rows(batch, node, 0, lengths, left[who], sketch)
                trees = np.array([trees_of(int(f), p) for f in many[left]], np.int64)
                for t in range(trees.max(initial=0)):
                    owner = np.flatnonzero(trees > t)
                    node, who = descend(tokens, many[left], np.repeat(seed(t), len(owner)), owner, 0, depth_of(p), p)
                    yield _node_rows(batch, node, depth_of(p), lengths, left[who], sketch)

    return run


def _rows_from_nodes(frequent: np.ndarray, p: Params):
    """Node rows of batches (rep, tokens, node, level): nodes split once more, repeatedly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                tokens, lengths = _lists(batch.column(1))
                sketch = sketches(tokens, _starts(lengths)) if batch.num_rows else None
                often, many = _only_frequent(tokens, lengths, frequent)
                levels = batch.column(3).to_numpy()
                for level in np.unique(levels).tolist():
                    owner = np.flatnonzero(levels == level)
                    roots = batch.column(2).to_numpy()[owner].view(np.uint64)
                    for again in range(splits(p)):
                        node, who = descend(tokens[often], many, roots ^ np.uint64(again * _DENSE % 2**64), owner, level, 1, p)
                        yield _node_rows(batch, node, min(level + 1, 15), lengths, who, sketch)

    return run


def _compare(p: Params, limit: int | None):
    """Sorted node rows to candidate pairs (kind 0), and the rows of nodes above the limit
    (kind 1), which are passed on without being gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, a: pa.Array, b: pa.Array, node: pa.Array, level: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), a, b, node, level], names=["kind", "a", "b", "node", "level"])

        def passed_on(t: pa.Table) -> pa.RecordBatch:
            place = t.column("place").to_numpy()
            rep = t.column("rep").combine_chunks()
            return out(1, rep, rep, pa.array(place >> _NODE << _NODE), pa.array((place >> _SIZE & 15).astype(np.int32)))

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if not t.num_rows:
                return
            place = t.column("place").to_numpy()
            node = place >> _NODE
            starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            sizes = np.diff(np.append(starts, len(node)))
            over = np.repeat(sizes > limit, sizes) if limit else np.zeros(len(node), bool)
            if over.any():
                yield passed_on(t.filter(pa.array(over)))
            keep = np.flatnonzero(~over)
            rep, sketch = t.column("rep").to_numpy()[keep], t.column("sketch").to_numpy()[keep].view(np.uint64)
            for i, j in pairs_in_runs(node[keep], place[keep] & _MOST, sketch, p):
                if len(i):
                    zero = np.zeros(len(i), np.int64)
                    yield out(0, pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j])), pa.array(zero), pa.array(zero.astype(np.int32)))

        held: pa.Table | None = None
        large: int | None = None  # a node of which rows have been passed on already
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if large is not None:
                here = t.column("place").to_numpy() >> _NODE
                more = int(np.argmin(here == large)) if (here != large).any() else len(here)
                if more:
                    yield passed_on(t.slice(0, more))
                t = t.slice(more)
                if not t.num_rows:
                    continue
                large = None
            t = t if held is None else pa.concat_tables([held, t])
            node = t.column("place").to_numpy() >> _NODE
            tail = int(np.searchsorted(node, node[-1], "left"))  # sorted by place
            yield from work(t.slice(0, tail))
            held = t.slice(tail)
            if limit and held.num_rows > limit:
                large = int(node[-1])
                yield passed_on(held)
                held = None
        if held is not None:
            yield from work(held)

    return run


def token_hashes(tags: Column) -> Column:
    """A sorted array of 64-bit hashes of the distinct tags. The numbers between the parts
    keep them apart, as the hash passes over an absent one."""
    one = lambda t: F.xxhash64(t["ns"], F.lit(1), t["key"], F.lit(2), t["value"])
    return F.sort_array(F.array_distinct(F.transform(F.coalesce(tags, F.array().cast("array<struct<ns:string,key:string,value:string>>")), one)))


def record_sets(tables: list[DataFrame], p: Params) -> DataFrame:
    """``(id, rid, tokens, f1, f2)`` of records with at least ``least`` distinct tags,
    saved: each table is read once. f1 and f2 together are 128 bits that stand for the set."""
    rows = reduce(DataFrame.unionByName, [t.select("id", token_hashes(F.col("tags")).alias("tokens")) for t in tables])
    kept = rows.filter(F.col("id").isNotNull() & (F.size("tokens") >= p.least))
    return saved(kept.select("id", F.xxhash64("id").alias("rid"), "tokens", F.xxhash64("tokens").alias("f1"), F.xxhash64(F.lit(7), "tokens").alias("f2")))


def frequent_tokens(sets: DataFrame, p: Params) -> np.ndarray:
    """The most frequent tokens, by a sketch of bounded size. Only a hint where to go on
    splitting: a pair that shares a token not named here is found for certain."""
    if p.frequent == 0:
        return np.zeros(0, np.uint64)
    top = sets.select(F.explode("tokens").alias("t")).agg(F.expr(f"approx_top_k(t, {p.frequent // 2}, {2 * p.frequent})").alias("top")).first()["top"]
    return np.sort(np.array([r["item"] for r in top or [] if r["count"] > p.limit // 2], np.int64).view(np.uint64))


def _candidates(reps: DataFrame, frequent: np.ndarray, p: Params) -> DataFrame:
    """Distinct ``(a, b)``, a < b, of representatives that met in a small node."""

    def compare(rows: DataFrame, limit: int | None) -> DataFrame:
        lined_up = rows.repartition(F.shiftright("place", _NODE)).sortWithinPartitions("place")
        return lined_up.mapInArrow(_compare(p, limit), _FOUND).filter((F.col("kind") == 1) | (F.col("a") != F.col("b"))).distinct()

    reps = reps.select(F.col("rid").alias("rep"), "tokens")
    rows = reps.mapInArrow(_rows_from_top(frequent, p), _ROWS)
    found, blocks = [], []
    for k in range(p.rounds + 1):
        met = saved(compare(rows, p.limit))
        found.append(met.filter("kind = 0").select("a", "b"))
        left = met.filter("kind = 1").select(F.col("a").alias("rep"), "node", "level")
        if left.isEmpty():
            break
        left = saved(left.join(left.groupBy("node").agg(F.count("*").alias("size")), "node"))
        large = (F.col("size") > p.whole) & (F.col("level") > 0) if k < p.rounds else F.lit(False)
        blocks.append(left.filter(~large))
        left = left.filter(large)
        if k == p.rounds or left.isEmpty():
            break
        again = reps.join(_few(left, p), "rep").select("rep", "tokens", "node", "level")
        rows = again.mapInArrow(_rows_from_nodes(frequent, p), _ROWS)
    if blocks:
        # Larger nodes that aren't split: every block of the node against every other. What is
        # dealt out to the blocks are sketches, not sets.
        whole = reduce(DataFrame.union, blocks).withColumn("blocks", F.ceil(F.col("size") / p.block).cast("int")).drop("size")
        sized = reps.mapInArrow(_sketched, "rep bigint, size int, sketch bigint").join(_few(whole, p), "rep")
        mine = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int")
        spread = sized.select("rep", "size", "sketch", "node", mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
        square = F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j"))
        place = F.shiftleft(F.shiftright(square, _NODE), _NODE).bitwiseOR(F.least("size", F.lit(_MOST)).cast("bigint"))
        found.append(compare(spread.select(place.alias("place"), "rep", "sketch"), None).select("a", "b"))
    return reduce(DataFrame.union, found).distinct()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            if batch.num_rows:
                tokens, lengths = _lists(batch.column(1))
                sketch = sketches(tokens, _starts(lengths)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths.astype(np.int32)), pa.array(sketch)], names=["rep", "size", "sketch"])


def _few(df: DataFrame, p: Params, within: DataFrame | None = None, times: int = 1) -> DataFrame:
    """Broadcast a side whose size is measured and small enough; a larger one is shuffled. Rows
    count as 64 bytes and what their texts hold. within: a table at hand of which df holds no
    more than ``times`` the rows and texts, measured in its place."""
    at_hand = df if within is None else within
    texts = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, t in at_hand.dtypes if t == "string"]
    size = at_hand.agg((F.count("*") * 64 + reduce(lambda a, b: a + b, texts, F.lit(0))).alias("size")).first()["size"]
    return F.broadcast(df) if times * size <= p.broadcast_bytes else df


def similar_representatives(reps: DataFrame, p: Params) -> DataFrame:
    """Verified ``(a, b, overlap, either)`` of representatives' ids, a < b by bytes, with
    the sizes of intersection and union."""
    pairs = saved(_candidates(reps, frequent_tokens(reps, p), p))
    involved = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    sets = saved(reps.join(_few(involved, p, pairs, 2), "rid").select("rid", "id", "tokens"))
    side = lambda x: sets.select(F.col("rid").alias(x), F.col("id").alias(f"id_{x}"), F.col("tokens").alias(f"t{x}"))
    overlap = F.size(F.array_intersect("ta", "tb"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").select(
        F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), overlap.alias("overlap"), (F.size("ta") + F.size("tb") - overlap).alias("either")
    )
    return sized.filter((F.col("a") != F.col("b")) & (F.col("overlap") * p.den >= F.col("either") * p.num)).distinct()


def fold_copies(sets: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(representatives, copies): the records less all but the first of each group of equal
    sets, and ``(rep, id, copies)`` of the groups of two or more, rep being the least id."""
    groups = saved(sets.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep != last").drop("last"))
    members = sets.select("f1", "f2", "id").join(_few(groups, p), ["f1", "f2"]).select("rep", "id").distinct()
    copies = saved(members.join(members.groupBy("rep").agg(F.count("*").alias("copies")), "rep"))
    others = copies.filter("id != rep").select("id")
    return sets.join(_few(others, p, copies), "id", "left_anti"), copies


def similar_pairs(tables: list[DataFrame], p: Params | None = None) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b by bytes: all pairs of records, within and between
    the tables, whose tag sets have a Jaccard similarity of at least ``num / den``; for tables
    with large groups of copies see :func:`similarity_classes`.

    Sets are of whole triples, repeats counting once, absent and empty parts differing.
    Records with fewer than ``least`` tags, null ids, null and empty sets are in no pair;
    a repeated row is no pair with itself. Tags are compared by 64-bit hashes; two tags of
    one pair collide with a probability below 2**-50. Copies are joined through their
    representative, and each pair of them is spelled out, as the query asks for records.
    """
    p = p or Params()
    reps, copies = fold_copies(record_sets(tables, p), p)
    linked = similar_representatives(reps, p).select("a", "b")
    member = lambda x: copies.select(F.col("rep").alias(x), F.col("id").alias(f"id_{x}"))
    spelled = linked.join(member("a"), "a", "left").join(member("b"), "b", "left").select(F.coalesce("id_a", "a").alias("x"), F.coalesce("id_b", "b").alias("y"))
    # Every pair of a group, which may be large: each member meets the others in parts.
    parts = F.ceil(F.col("copies") / p.block).cast("int")
    dealt = copies.select("rep", "id", F.pmod(F.xxhash64("id", F.lit(5)), parts).cast("int").alias("part"))
    against = copies.select("rep", F.col("id").alias("other"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    alike = dealt.join(against, ["rep", "part"]).filter("id < other").select(F.col("id").alias("x"), F.col("other").alias("y"))
    pairs = spelled.filter("x != y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return pairs.union(alike).distinct()


def similarity_classes(tables: list[DataFrame], p: Params | None = None) -> DataFrame:
    """``(id, class_id, copies, links)``: every record with at least ``least`` tags, the
    least id of its group of equal sets, that group's size, and to how many other groups
    its set is similar. Copies aren't spelled out."""
    p = p or Params()
    sets = record_sets(tables, p)
    reps, copies = fold_copies(sets, p)
    linked = similar_representatives(reps, p)
    degree = linked.select("a").union(linked.select("b")).groupBy(F.col("a").alias("class_id")).agg(F.count("*").alias("links"))
    named = sets.select("id").distinct().join(copies, "id", "left")
    classes = named.select("id", F.coalesce("rep", "id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"))
    return classes.join(degree, "class_id", "left").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
