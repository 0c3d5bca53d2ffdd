"""How often two keys occur on the same item, and whether that is more than chance.

Pairs are counted exactly: each partition counts its own items' pairs in compact arrays
and sends one number per pair it met. An item of very many keys is cut into blocks of keys,
and its pairs of blocks are spread over all tasks. What chance would give is a bipartite configuration
model fitted to the data: every key keeps its expected number of items and every item its
expected number of keys, and given that, keys fall on items independently. A pair's count
is then Poisson-binomial; its upper tail gives a p-value, and Benjamini and Hochberg's
rule over all possible pairs marks those that are surprising.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erfc, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.checkpoints import saved

#: Distinct pairs a partition holds before it sends what it has.
HOLD = 2_000_000
#: An item with more keys than this is counted in blocks of so many keys.
BLOCK = 1_024
#: Degrees and sizes up to this are classes of their own in the fit of the null model, larger ones
#: share a class with those within 1 part in 100, which stands at their mean: sums stay exact, and
#: the driver holds under 3,000 classes of either up to 10**12 items. Counts are never rounded.
EXACT = 256
_COUNTS = "kind int, a string, b string, n bigint"
_PAIR, _KEY, _SIZE = 0, 1, 2


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (keys, keys of another block, size) to partial counts of pairs (a < b), of keys, and
    of basket sizes (a: NULL, b: size). Two blocks give the pairs between them; keys alone give
    those among them, and count as keys. Without a size all keys of an item are at hand; the size
    of one in blocks comes with the first of them, the others say -1."""
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    weight = 0
    sizes: dict[int, int] = {}

    def fold() -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate([c for c, _ in held])
        counts = np.concatenate([n for _, n in held])
        u, at = np.unique(codes, return_inverse=True)
        return u, np.bincount(at, counts, len(u)).astype(np.int64)

    def send() -> Iterator[pa.RecordBatch]:
        if held:
            u, n = fold()
            held.clear()
            words = pa.array(list(names))
            a, b = words.take(pa.array(u >> 32)), words.take(pa.array(u & 0xFFFFFFFF))
            swap = pc.greater(a, b)
            kind = np.where(u >> 32 == u & 0xFFFFFFFF, _KEY, _PAIR).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pc.if_else(swap, b, a), pc.if_else(swap, a, b), pa.array(n)], names=["kind", "a", "b", "n"])

    def coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of the keys of each row, by row, each key once."""
        item = pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.list_flatten(column)
        known = pc.is_valid(words).to_numpy(zero_copy_only=False)
        by_word = words.filter(pa.array(known)).dictionary_encode()
        local = np.array([names.setdefault(w, len(names)) for w in by_word.dictionary.to_pylist()], np.int64)
        key = local[by_word.indices.to_numpy(zero_copy_only=False)] if len(local) else np.zeros(0, np.int64)
        once = np.unique((item[known] << 32) | key)
        return once >> 32, once & 0xFFFFFFFF

    for batch in batches:
        item, key = coded(batch.column(0))
        per = np.bincount(item, minlength=batch.num_rows) if batch.num_rows else np.zeros(0, np.int64)
        whole = np.where(pc.is_null(batch.column(2)).to_numpy(zero_copy_only=False), per, pc.fill_null(batch.column(2), 0).to_numpy())
        for s, n in zip(*np.unique(whole[whole >= 0], return_counts=True), strict=True):
            sizes[int(s)] = sizes.get(int(s), 0) + int(n)
        if batch.column(1).null_count < batch.num_rows:  # pairs of two blocks
            across = pc.is_valid(batch.column(1)).to_numpy(zero_copy_only=False)
            left, right = item, key
            of, other = coded(batch.column(1))
            for row in np.flatnonzero(across).tolist():
                a, b = right[slice(*np.searchsorted(left, [row, row + 1]))], other[slice(*np.searchsorted(of, [row, row + 1]))]
                u, n = np.unique(np.minimum(a[:, None], b) << 32 | np.maximum(a[:, None], b), return_counts=True)
                held.append((u, n))
                weight += len(u)
                if weight > HOLD:
                    held[:] = [fold()]
                    weight = len(held[0][0])
                    if weight > HOLD // 2:
                        yield from send()
                        weight = 0
            item, key = item[~across[item]], key[~across[item]]
        i, step = np.arange(len(key)), 0
        while len(i):  # every key with the step-th after it on the same item
            u, n = np.unique((key[i] << 32) | key[i + step], return_counts=True)
            held.append((u, n))
            weight += len(u)
            step += 1
            i = i[i + step < len(key)]
            i = i[item[i] == item[i + step]]
            if weight > HOLD:
                held[:] = [fold()]
                weight = len(held[0][0])
                if weight > HOLD // 2:
                    yield from send()
                    weight = 0
        if len(names) > HOLD:
            yield from send()
            names.clear()
            weight = 0
    yield from send()
    if sizes:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(sizes), _SIZE, np.int32)), pa.array([None] * len(sizes), pa.string()), pa.array(map(str, sizes)), pa.array(list(sizes.values()), pa.int64())],
            names=["kind", "a", "b", "n"],
        )


def baskets(items: DataFrame, block: int | None = None) -> DataFrame:
    """``(keys, others, size)``: a row per item with its keys, or of one with many tags a row per
    block and per pair of blocks of its distinct keys, dealt out over all tasks."""
    block = block or BLOCK
    none = F.lit(None)
    small = items.filter(F.coalesce(F.size("tags"), F.lit(0)) <= block).select(
        F.coalesce(F.col("tags.key"), F.array().cast("array<string>")).alias("keys"), none.cast("array<string>").alias("others"), none.cast("int").alias("size")
    )
    keys = F.array_distinct(F.filter(F.col("tags.key"), lambda k: k.isNotNull()))
    n = F.greatest(F.ceil(F.size("keys") / block), F.lit(1)).cast("int")
    pick = lambda k: F.slice("keys", k * block + 1, block)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(i, n - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    large = items.filter(F.size("tags") > block).select(keys.alias("keys"), F.monotonically_increasing_id().alias("deal"))
    first = (F.col("i") == 0) & (F.col("j") == 0)
    large = large.select("keys", "deal", F.inline(pairs)).select(
        pick(F.col("i")).alias("keys"), F.when(F.col("i") < F.col("j"), pick(F.col("j"))).alias("others"), F.when(first, F.size("keys")).otherwise(-1).alias("size"), "deal", "i", "j"
    )
    return small.unionByName(large.repartition("deal", "i", "j").drop("deal", "i", "j"))


def counts(items: DataFrame) -> DataFrame:
    """``(kind, a, b, n)``, saved: pairs, keys, and basket sizes."""
    return saved(baskets(items).mapInArrow(_count_batches, _COUNTS).groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))


@dataclass(frozen=True)
class NullModel:
    """Weights of the basket classes: p(key, basket) = x y / (1 + x y)."""

    y: np.ndarray
    baskets: np.ndarray

    def probabilities(self, degree: np.ndarray) -> np.ndarray:
        """For each degree, the chance to lie on a basket of each class, so that the
        expected number of baskets is the degree (Newton steps kept within a bracket)."""
        degree = np.asarray(degree, float)
        total = self.baskets.sum()
        low, high = np.full(len(degree), -60.0), np.full(len(degree), 60.0)
        log_y = np.log(self.y)
        at = np.log(np.maximum(degree, 1e-9) / np.maximum(total - degree, 1e-9)) - np.average(log_y, weights=self.baskets)
        at = np.clip(at, -59, 59)
        for _ in range(60):
            p = 1 / (1 + np.exp(-(at[:, None] + log_y)))
            gap = p @ self.baskets - degree
            high, low = np.where(gap > 0, at, high), np.where(gap > 0, low, at)
            slope = (p * (1 - p)) @ self.baskets
            new = at - gap / np.maximum(slope, 1e-300)
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            if np.all(np.abs(new - at) < 1e-12):
                break
            at = new
        return p


def fit(sizes: np.ndarray, baskets: np.ndarray, degrees: np.ndarray, keys: np.ndarray, rounds: int = 2_000) -> NullModel:
    """Maximum-entropy weights by fixed-point steps over classes of equal size or degree."""
    full = sizes > 0
    sizes, baskets = sizes[full].astype(float), baskets[full].astype(float)
    degrees, keys = degrees.astype(float), keys.astype(float)
    if not len(sizes) or not len(degrees):
        return NullModel(np.ones(1), np.zeros(1))
    edges = float((degrees * keys).sum())
    x, y = degrees / np.sqrt(edges), sizes / np.sqrt(edges)
    for _ in range(rounds):
        x = np.minimum(degrees / ((baskets * y) / (1 + np.outer(x, y))).sum(1), 1e15)
        new = np.minimum(sizes / ((keys * x)[:, None] / (1 + np.outer(x, y))).sum(0), 1e15)
        done = np.max(np.abs(new / y - 1)) < 1e-9
        y = new
        if done:
            break
    return NullModel(y, baskets)


def tail(n: np.ndarray, q: np.ndarray, baskets: np.ndarray) -> np.ndarray:
    """P(X >= n) for X a sum of Bernoulli(q[:, s]), baskets[s] of each: a saddlepoint
    approximation for whole numbers, exact at the ends."""
    mean, top = q @ baskets, ((q > 0) * baskets).sum(1)
    n = n.astype(float)
    # P(X >= n) at the ends; between them the saddlepoint t solves K'(t) = n.
    t = np.zeros(len(n))
    low, high = np.full(len(n), -50.0), np.full(len(n), 50.0)
    inside = (n > 0) & (n < top)
    for _ in range(80):
        e = q * np.exp(t)[:, None]
        r = e / (1 - q + e)
        gap = r @ baskets - n
        high, low = np.where(gap > 0, t, high), np.where(gap > 0, low, t)
        step = t - gap / np.maximum((r * (1 - r)) @ baskets, 1e-300)
        new = np.where((step > low) & (step < high), step, (low + high) / 2)
        if np.all(np.abs(new - t)[inside] < 1e-10):
            break
        t = new
    e = q * np.exp(t)[:, None]
    r = e / (1 - q + e)
    k = np.log1p(q * np.expm1(t)[:, None]) @ baskets
    var = (r * (1 - r)) @ baskets
    w = np.sign(t) * np.sqrt(np.maximum(2 * (t * n - k), 0))
    u = -np.expm1(-t) * np.sqrt(var)
    half = np.array([0.5 * erfc(v / sqrt(2)) for v in w])
    with np.errstate(all="ignore"):
        p = half + np.exp(-w * w / 2) / sqrt(2 * np.pi) * (1 / u - 1 / w)
    # At the mean both terms are infinite; the normal law with a half step stands in.
    sd = np.sqrt(np.maximum((q * (1 - q)) @ baskets, 1e-300))
    normal = np.array([0.5 * erfc(v / sqrt(2)) for v in (n - 0.5 - mean) / sd])
    p = np.where(np.abs(w) < 1e-3, normal, p)
    with np.errstate(all="ignore"):
        all_hit = np.exp(np.where(q > 0, np.log(q), 0) @ baskets)
    p = np.where(n <= 0, 1.0, np.where(n > top, 0.0, np.where(n >= top, all_hit, p)))
    return np.clip(np.nan_to_num(p, nan=1.0), 0, 1)


def _classes(counted: DataFrame, size: Column, weight: Column) -> tuple[np.ndarray, np.ndarray]:
    """(mean size, how many) of the classes of sizes, by size."""
    near = F.when(size <= EXACT, size.cast("double")).otherwise(EXACT + 1 + F.floor(F.log(size / EXACT) / np.log(1.01)))
    rows = counted.groupBy(near.alias("class")).agg((F.sum(size.cast("double") * weight) / F.sum(weight)).alias("mean"), F.sum(weight).alias("c")).collect()
    rows.sort(key=lambda r: r["class"])
    return np.array([r["mean"] for r in rows], float), np.array([r["c"] for r in rows], float)


def _model(counted: DataFrame) -> tuple[NullModel, int, int]:
    """The fitted null, the number of records and of keys. What comes to the driver are
    classes of sizes and degrees, not the keys."""
    degrees, keys = _classes(counted.filter(F.col("kind") == _KEY), F.col("n"), F.lit(1))
    sizes, records = _classes(counted.filter(F.col("kind") == _SIZE), F.col("b").cast("int"), F.col("n"))
    return fit(sizes, records, degrees, keys), int(records.sum()), int(keys.sum())


def lift(n_ab: Column, n_a: Column, n_b: Column, records: int) -> Column:
    return n_ab.cast("double") * F.lit(float(records)) / (n_a.cast("double") * n_b.cast("double"))


def pair_counts(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, counted): pairs are ``(key_a, key_b, n_a, n_b, n_ab)``, key_a < key_b by
    bytes, of all keys that meet on an item; counted is what :func:`counts` gives.

    A key counts once per item, whatever its namespaces. Null keys, null and empty tag
    lists count for nothing but the number of records. Repeated rows are records each.
    """
    counted = counts(items)
    key = lambda x: counted.filter(F.col("kind") == _KEY).select(F.col("a").alias(f"key_{x}"), F.col("n").alias(f"n_{x}"))
    pairs = counted.filter(F.col("kind") == _PAIR).select(F.col("a").alias("key_a"), F.col("b").alias("key_b"), F.col("n").alias("n_ab"))
    return pairs.join(key("a"), "key_a").join(key("b"), "key_b").select("key_a", "key_b", "n_a", "n_b", "n_ab"), counted


def _ranked(pairs: DataFrame, p: str) -> DataFrame:
    """Rows with their rank by p, numbered across range partitions: no single task sorts
    everything, and the offsets are one number per partition. Equal p, such as those too small
    for a double, are ordered by their keys, so they spread too; the last of them has the rank
    that counts for all."""
    order = [p, "key_a", "key_b"]
    lined_up = saved(pairs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lined_up.groupBy(part.alias("part")).agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    numbered = lined_up.join(F.broadcast(offsets), part == F.col("part"))
    return numbered.withColumn("rank", F.col("offset") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).drop("place", "part", "offset")


def surprising_pairs(items: DataFrame, rate: float = 0.05) -> DataFrame:
    """``(key_a, key_b, n_a, n_b, n_ab, lift, expected, p_value, surprising, records)`` of
    all pairs of keys that meet on an item; surprising holds the false discovery rate over
    all possible pairs. An empty table gives no rows."""
    pairs, counted = pair_counts(items)
    model, records, keys = _model(counted)

    @F.pandas_udf("expected double, p_value double")
    def chance(n_ab: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.DataFrame:
        degrees, at = np.unique(np.concatenate([n_a, n_b]), return_inverse=True)
        p = model.probabilities(degrees)
        a, b = at[: len(n_a)], at[len(n_a) :]
        expected, tails = np.empty(len(n_ab)), np.empty(len(n_ab))
        for i in range(0, len(n_ab), 4096):
            q = p[a[i : i + 4096]] * p[b[i : i + 4096]]
            expected[i : i + 4096] = q @ model.baskets
            tails[i : i + 4096] = tail(n_ab.to_numpy()[i : i + 4096], q, model.baskets)
        return pd.DataFrame({"expected": expected, "p_value": tails})

    scored = pairs.withColumn("chance", chance("n_ab", "n_a", "n_b")).select(
        "key_a", "key_b", "n_a", "n_b", "n_ab", lift(F.col("n_ab"), F.col("n_a"), F.col("n_b"), records).alias("lift"), "chance.expected", "chance.p_value"
    )
    ranked = _ranked(scored, "p_value")
    tests = max(keys * (keys - 1) // 2, 1)
    cutoff = ranked.filter(F.col("p_value") <= F.col("rank") * F.lit(rate / tests)).agg(F.max("p_value").alias("c")).first()["c"]
    return ranked.select(
        "key_a", "key_b", "n_a", "n_b", "n_ab", "lift", "expected", "p_value",
        (F.col("p_value") <= F.lit(-1.0 if cutoff is None else cutoff)).alias("surprising"), F.lit(records).cast("bigint").alias("records"),
    )


def found_pairs(items: DataFrame, least: int = 5, per_mille: int = 4, times: int = 3) -> DataFrame:
    """``(key_a, key_b)`` of pairs on at least ``least`` items and ``per_mille`` of all,
    that meet at least ``times`` as often as under independence (compared in whole numbers)."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    n, n_ab = wide("records"), wide("n_ab")
    often = (F.col("n_ab") >= least) & (F.col("n_ab") * 1000 >= F.col("records") * per_mille)
    return surprising_pairs(items).filter(often & (n_ab * n >= wide("n_a") * wide("n_b") * times)).select("key_a", "key_b")
