import random
from itertools import combinations
from math import comb

import numpy as np
import pytest

from tagloom.llm import cooccur, setjoin
from tagloom.model import NESTED


def nested(spark, rows):
    return spark.createDataFrame(rows, NESTED)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# 2: similar sets


def brute_pairs(rows, num=3, den=4, least=5):
    sets = {}
    for i, tags in rows:
        if i is not None:
            sets.setdefault(i, set()).update(tags or [])
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) * den >= len(sets[a] | sets[b]) * num}


def store(seed, groups=40, copies=60):
    rng = random.Random(seed)
    common = [(None, "lang", v) for v in "ab"] + [("s", "state", v) for v in ("", None, "x")] + [(None, "hop", str(k)) for k in range(12)]
    rows = []
    for g in range(groups):
        base = [*rng.sample(common, 7), *[("u", "k", f"{g}-{k}") for k in range(rng.randint(0, 9))]]
        for m in range(rng.randint(1, 4)):
            tags = list(base)
            for _ in range(rng.randint(0, 3)):
                tags[rng.randrange(len(tags))] = ("m", "k", str(rng.random()))
            rng.shuffle(tags)
            rows.append((f"r{g}-{m}", tags + tags[:2]))
    rows += [(f"copy{k:03d}", [("c", "k", str(j)) for j in range(8)]) for k in range(copies)]
    rows += [("near", [("c", "k", str(j)) for j in range(9)]), ("null", None), ("none", []), ("few", [("c", "k", str(j)) for j in range(4)])]
    return rows


@pytest.mark.parametrize("p", [setjoin.Params(), setjoin.Params(limit=4, frequent=20, depth=2), setjoin.Params(limit=3, frequent=0, depth=1, rounds=2, block=4)])
def test_similar_pairs(spark, p):
    rows = store(3)
    half = len(rows) // 2
    want = brute_pairs(rows)
    got = {tuple(r) for r in setjoin.similar_pairs([nested(spark, rows[:half]), nested(spark, rows[half:] + rows[half : half + 5])], p).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert {x for x in want if x[0].startswith("copy")} <= got  # copies, and what they are near


def skewed(seed, sizes, tags=60, records=150):
    """Records of a few tags that all are frequent, in groups of similar ones."""
    rng = random.Random(seed)
    rows = []
    for k in range(records):
        tags_of = rng.choices(range(tags), [1 / (t + 3) for t in range(tags)], k=200)
        base = list(dict.fromkeys(tags_of))[: rng.choice(sizes)]
        for m in range(4):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 8))):
                if rng.random() < 0.5 and len(own) > 5:
                    own.pop(rng.randrange(len(own)))
                else:
                    own.append(rng.randrange(tags))
            rows.append((f"r{k}-{m}", [(None, "t", str(t)) for t in own]))
    return rows


def test_short_sets_of_frequent_tags_meet_for_certain(spark):
    rows = skewed(7, [5, 6, 7, 8], tags=20)
    tags = [t for _, own in rows for t in set(own)]
    assert min(tags.count(t) for t in set(tags)) > setjoin.Params().limit // 2
    # Up to 8 shared tags: certain, not likely.
    want = {(a, b) for a, b in brute_pairs(rows) if len(set(dict(rows)[a]) & set(dict(rows)[b])) <= 8}
    got = {tuple(r) for r in setjoin.similar_pairs([nested(spark, rows)]).collect()}
    assert len(want) > 500 and want <= got <= brute_pairs(rows)


@pytest.mark.parametrize("overlap,size", [(9, 9), (9, 12), (12, 15), (18, 24)])
def test_trees_reach_the_recall(overlap, size):
    p = setjoin.Params()
    trees, tries = min(setjoin.trees_of(overlap, p), setjoin.trees_of(size, p)), 1_500
    tokens = np.random.default_rng(5).integers(0, 2**63, (tries, size), dtype=np.uint64)
    met = np.zeros(tries, bool)
    with np.errstate(over="ignore"):
        for t in range(trees):
            ends = []
            for n in (overlap, size):
                lengths, roots = np.full(tries, n), np.full(tries, setjoin._mix(np.uint64(t + 1)))
                node, owner = setjoin.descend(tokens[:, :n].ravel(), lengths, roots, np.arange(tries), 0, setjoin.depth_of(p), p)
                ends.append(set(zip(node.tolist(), owner.tolist(), strict=True)))
            met[[o for _, o in ends[0] & ends[1]]] = True
    assert met.mean() >= p.recall - 0.006


def test_more_recall_takes_more_trees():
    few, many = setjoin.Params(recall=0.9, trees=1), setjoin.Params(recall=0.999, trees=1)
    assert setjoin.trees_of(9, few) < setjoin.trees_of(9, many) and setjoin.splits(few) < setjoin.splits(many)
    assert setjoin.trees_of(12, setjoin.Params(trees=1)) >= setjoin.trees_of(40, setjoin.Params(trees=1))


def test_long_sets_of_frequent_tags(spark):
    rows = skewed(8, [9, 11, 13, 16], tags=45, records=250)
    want = brute_pairs(rows)
    for p in (setjoin.Params(), setjoin.Params(limit=8, whole=16, rounds=2)):
        got = {tuple(r) for r in setjoin.similar_pairs([nested(spark, rows)], p).collect()}
        assert got <= want and len(got) >= p.recall * len(want)


def apart(rows):
    return [(f"s{i}", tags) for i, tags in rows]


@pytest.mark.parametrize("num,den", [(1, 2), (3, 5), (3, 4), (9, 10)])
def test_recall_at_other_thresholds(spark, num, den):
    rows = [*skewed(9, [5, 7, 10, 14], tags=45, records=120), *apart(store(9, groups=60, copies=5))]
    want = brute_pairs(rows, num, den)
    p = setjoin.Params(num=num, den=den)
    assert len(want) > 100
    got = {tuple(r) for r in setjoin.similar_pairs([nested(spark, rows)], p).collect()}
    assert got <= want and len(got) >= 0.99 * len(want), (len(got), len(want))


@pytest.mark.parametrize("num,den", [(1, 2), (3, 4)])
def test_the_exact_way(spark, num, den):
    rows = [*skewed(10, [6, 9, 12], tags=40, records=80), *apart(store(10, groups=30, copies=40))]
    p = setjoin.Params(num=num, den=den, exact=True, limit=8, block=16)
    assert {tuple(r) for r in setjoin.similar_pairs([nested(spark, rows)], p).collect()} == brute_pairs(rows, num, den)


def test_large_sides_are_shuffled(spark):
    rows = store(11, groups=20, copies=30)
    p = setjoin.Params(limit=4, broadcast_bytes=0, block=7)
    assert {tuple(r) for r in setjoin.similar_pairs([nested(spark, rows)], p).collect()} == brute_pairs(rows)


def test_classes(spark):
    rows = store(4, groups=5, copies=30)
    got = {r.id: r for r in setjoin.similarity_classes([nested(spark, rows)]).collect()}
    assert {r.copies for i, r in got.items() if i.startswith("copy")} == {30} and {r.class_id for i, r in got.items() if i.startswith("copy")} == {"copy000"}
    assert got["near"].links == 1 and got["copy007"].links == 1 and "few" not in got and "null" not in got


def test_no_records(spark):
    empty = nested(spark, [])
    assert rows_of(setjoin.similar_pairs([empty, empty])) == [] and rows_of(setjoin.similarity_classes([empty])) == []
    extra = spark.createDataFrame([("a", [(None, "k", str(j)) for j in range(6)], "x", 1)], "id string, tags array<struct<ns:string,key:string,value:string>>, rep string, node int")
    assert rows_of(setjoin.similar_pairs([extra, extra])) == []


def test_hashes_keep_parts_apart(spark):
    from pyspark.sql import functions as F

    tags = [(None, "a", "b"), ("a", "b", None), ("", "a", "b"), (None, "a", ""), (None, "a", None), ("a", "", "b"), (None, "ab", None)]
    df = nested(spark, [("x", tags + tags)])
    assert df.select(F.size(setjoin.token_hashes(F.col("tags"))).alias("n")).first().n == len(tags)


def test_sketches_estimate():
    rng = np.random.default_rng(1)
    shared, own = rng.integers(0, 2**63, 60, dtype=np.uint64), rng.integers(0, 2**63, 20, dtype=np.uint64)
    with np.errstate(over="ignore"):
        s = setjoin.sketches(np.concatenate([shared, own[:10], shared, own[10:]]), np.array([0, 70]))
    assert np.bitwise_count(s[0] ^ s[1]) <= setjoin.SKETCH_BITS


@pytest.mark.parametrize("num,den", [(3, 4), (1, 2), (9, 10)])
def test_sketches_keep_similar_pairs(num, den):
    p = setjoin.Params(num=num, den=den)
    differ = np.random.default_rng(6).binomial(64, (1 - num / den) / 2, 200_000)
    assert (differ > setjoin.sketch_bits(p)).mean() <= 5 * p.missed
    here = np.zeros(2, np.uint64)
    here[1] = 2 ** setjoin.sketch_bits(p) - 1
    met = [len(i) for i, _ in setjoin.pairs_in_runs(np.zeros(2), np.array([9, 9]), here, p)]
    assert sum(met) == 1


# 3: keys that occur together


def exact_tail(n, q):
    law = np.array([1.0])
    for p in q:
        law = np.convolve(law, [1 - p, p])
    return law[n:].sum()


def test_tails_against_the_exact_law():
    rng = np.random.default_rng(2)
    for scale in (0.02, 0.2, 0.7):
        q = rng.random((3, 4)) * scale
        baskets = np.array([30.0, 12.0, 7.0, 1.0])
        for row in q:
            full = np.repeat(row, baskets.astype(int))
            mean = full.sum()
            for n in {0, 1, int(mean), int(mean) + 1, int(mean) + 5, 30, 50, 51}:
                got, want = cooccur.tail(np.array([n]), row[None], baskets)[0], exact_tail(n, full)
                assert got == pytest.approx(want, rel=0.12, abs=1e-12), (n, mean)


def test_fit_keeps_the_degrees():
    rng = np.random.default_rng(3)
    sizes, baskets = np.array([1, 2, 5, 9]), np.array([50, 40, 20, 3])
    weights = rng.dirichlet(np.ones(12)) * (sizes * baskets).sum()
    degrees = np.minimum(np.maximum(np.round(weights), 1), 100)
    degrees[0] += (sizes * baskets).sum() - degrees.sum()
    model = cooccur.fit(sizes, baskets, degrees, np.ones(12))
    p = model.probabilities(degrees)
    assert p @ model.baskets == pytest.approx(degrees, rel=1e-6) and p.sum(0) == pytest.approx(sizes, rel=1e-3)


def baskets(seed=5, n=600):
    rng = random.Random(seed)
    rows = [(f"i{k}", [(rng.choice([None, "n"]), f"k{min(int(rng.expovariate(0.3)), 14)}", None) for _ in range(rng.randint(0, 6))]) for k in range(n)]
    for k in range(40):
        rows[k][1].extend([(None, "tea", None), ("x", "cup", "1"), ("x", "cup", "2")])
    return [*rows, ("null", None), ("keyless", [(None, None, "v"), (None, "tea", None)])]


def test_surprising_pairs(spark):
    rows = baskets()
    keys = [{t[1] for t in tags or []} - {None} for _, tags in rows]
    got = {(r.key_a, r.key_b): r for r in cooccur.surprising_pairs(nested(spark, rows).repartition(3)).collect()}
    want = {}
    for ks in keys:
        for pair in combinations(sorted(ks), 2):
            want[pair] = want.get(pair, 0) + 1
    assert {p: r.n_ab for p, r in got.items()} == want
    for (a, b), r in got.items():
        n_a, n_b = sum(a in k for k in keys), sum(b in k for k in keys)
        assert (r.n_a, r.n_b, r.records) == (n_a, n_b, len(rows)) and r.lift == pytest.approx(r.n_ab * len(rows) / (n_a * n_b))
    assert got["cup", "tea"].surprising and got["cup", "tea"].p_value < 1e-12
    # The rate of false discoveries: the step-up rule by brute force.
    tests = comb(len({k for ks in keys for k in ks}), 2)
    ordered = sorted(r.p_value for r in got.values())
    cutoff = max((p for i, p in enumerate(ordered, 1) if p <= 0.05 * i / tests), default=-1)
    assert {p for p, r in got.items() if r.surprising} == {p for p, r in got.items() if r.p_value <= cutoff}
    assert sum(r.surprising for r in got.values()) < 0.2 * len(got)
    found = {tuple(r) for r in cooccur.found_pairs(nested(spark, rows)).collect()}
    assert found == {(a, b) for (a, b), r in got.items() if r.n_ab >= 5 and r.n_ab * 1000 >= 4 * len(rows) and r.n_ab * len(rows) >= 3 * r.n_a * r.n_b} and ("cup", "tea") in found


def test_counting_in_small_pieces(spark, monkeypatch):
    rows = baskets(6, 200)
    whole = rows_of(cooccur.pair_counts(nested(spark, rows))[0])
    import pyarrow as pa

    def run(hold):
        monkeypatch.setattr(cooccur, "HOLD", hold)
        keys = pa.array([[] if t is None else [x[1] for x in t] for _, t in rows], pa.list_(pa.string()))
        columns = [keys, pa.nulls(len(rows), keys.type), pa.nulls(len(rows), pa.int32())]
        batch = pa.RecordBatch.from_arrays(columns, ["keys", "others", "size"])
        out = {}
        for b in cooccur._count_batches(iter([batch.slice(k, 20) for k in range(0, len(rows), 20)])):
            for kind, a, c, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
                out[kind, a, c] = out.get((kind, a, c), 0) + n
        return out

    assert run(10) == run(10**6)
    assert {(a, b): n for (k, a, b), n in run(10).items() if k == 0} == {(r[0], r[1]): r[4] for r in whole}


@pytest.mark.parametrize("block", [1, 2, 5])
def test_large_baskets_are_cut(spark, monkeypatch, block):
    rows = [*baskets(9, 150), ("huge", [(None, f"k{k}", str(k % 3)) for k in range(40)] * 2)]
    want = {(r[0], r[1], r[2]): r[3] for r in cooccur.counts(nested(spark, rows)).collect()}
    cut_up = cooccur.baskets(nested(spark, rows), block).collect()
    assert max(len(r["keys"]) for r in cut_up) <= block and sum(r["size"] is None or r["size"] >= 0 for r in cut_up) == len(rows)
    monkeypatch.setattr(cooccur, "BLOCK", block)
    assert {(r[0], r[1], r[2]): r[3] for r in cooccur.counts(nested(spark, rows)).collect()} == want


def test_p_values_by_brute_force(spark):
    """The tail of each pair's exact Poisson-binomial law under the fitted weights."""
    rows = baskets(10, 120)
    model, records, _ = cooccur._model(cooccur.counts(nested(spark, rows)))
    for r in cooccur.surprising_pairs(nested(spark, rows)).collect():
        p = model.probabilities(np.array([r.n_a, r.n_b]))
        q = np.repeat(p[0] * p[1], model.baskets.astype(int))
        assert r.records == records and r.expected == pytest.approx(q.sum(), rel=1e-6)
        assert r.p_value == pytest.approx(exact_tail(r.n_ab, q), rel=0.12, abs=1e-12)


def test_ranks_of_equal_p_values(spark):
    """A hundred thousand keys, most pairs of one p-value: ranks are 1 to n, and no partition
    holds the ties alone."""
    from pyspark.sql import functions as F

    n = 100_000
    pairs = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key_a"), F.concat(F.lit("m"), "id").alias("key_b"), F.when(F.col("id") % 10 == 0, F.col("id") / n).otherwise(F.lit(0.0)).alias("p_value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = cooccur._ranked(pairs, "p_value")
        got = ranked.select("rank", "p_value").toPandas().sort_values("rank")
        assert got["rank"].tolist() == list(range(1, n + 1)) and got["p_value"].is_monotonic_increasing
        lined_up = pairs.repartitionByRange("p_value", "key_a", "key_b").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in lined_up) < 0.4 * n
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_classes_of_sizes_change_little(spark, monkeypatch):
    """Classes a hundredth wide against every degree and size on its own."""
    rng = random.Random(12)
    rows = [(f"i{k}", [(None, f"k{int(rng.paretovariate(0.6)) % 400}", None) for _ in range(rng.randint(1, 40))]) for k in range(1_500)]
    log_p = {}
    for exact in (10**9, 4):
        monkeypatch.setattr(cooccur, "EXACT", exact)
        found = cooccur.surprising_pairs(nested(spark, rows)).collect()
        log_p[exact] = {(r.key_a, r.key_b): (np.log(max(r.p_value, 1e-300)), r.surprising) for r in found}
    gaps = [abs(a - log_p[4][k][0]) / max(abs(a), 1) for k, (a, _) in log_p[10**9].items()]
    assert max(gaps) < 0.02 and sum(s != log_p[4][k][1] for k, (_, s) in log_p[10**9].items()) <= 0.001 * len(gaps) + 1


def test_no_items(spark):
    assert rows_of(cooccur.surprising_pairs(nested(spark, []))) == [] and rows_of(cooccur.found_pairs(nested(spark, [("a", []), ("b", None)]))) == []
    one = spark.createDataFrame([("a", [(None, "x", None), (None, "y", None)], 1, "q")], "id string, tags array<struct<ns:string,key:string,value:string>>, n int, key_a string")
    assert [(r.key_a, r.key_b, r.n_ab, r.lift) for r in cooccur.surprising_pairs(one).collect()] == [("x", "y", 1, 1.0)]
