import random

import pytest
from cases import SCENARIOS

from tagloom import HideConfig, Tag, Wild, compile_query
from tagloom.config import ROOT_NS, hide_ns, reference_of
from tagloom.functions.comparators import SEMVER, VERSION
from tagloom.model import NOT, TAGS, WRITES, Atom
from tagloom.operators.collapse import live_tags
from tagloom.parse import parse_tag
from tagloom.plans.planner import STRATEGIES
from tagloom.sources.layout import read_long, to_long, to_nested, write_long
from tagloom.store import TagStore

HIDE_NS = hide_ns()
ANY_STORE = [s for s in STRATEGIES if s != "columns"]


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenarios(spark, name):
    store = TagStore.empty(spark)
    store.register_type("semver", SEMVER)
    store.register_type("version", VERSION)
    asked = 0
    for what, a, b in SCENARIOS[name]:
        a, b = a.replace("{R}", ROOT_NS), b.replace("{R}", ROOT_NS)
        if what == "add":
            store.add_line(f"{a} {b}")
            continue
        run = store.query if what == "ask" else store.query_postfix
        strategy = ANY_STORE[asked % 3]  # all three plans, in turn
        asked += 1
        assert ids(run(a, strategy)) == b.split(), (a, strategy)


# A plain evaluator, item by item, to hold the three plans against.


def numeral(v):
    import re

    return float(v) if v is not None and re.fullmatch("[-+]?[0-9]+([.][0-9]+)?", v) else None


def tag_answers(atom: Atom, t: Tag) -> bool:
    if atom.ns is None and t.ns is not None or atom.ns is Wild.SOME and t.ns is None or isinstance(atom.ns, str) and atom.ns != t.ns:
        return False
    if isinstance(atom.key, str) and atom.key != t.key:
        return False
    if atom.op is None or atom.value is Wild.ANY:
        return True
    if t.value is None:
        return False
    if atom.value is Wild.SOME:
        return True
    if atom.op in ("=", "!="):
        return (t.value == atom.value) == (atom.op == "=")
    if atom.op == "~":
        return len(t.value) == len(atom.value) and all(p in (".", c) for p, c in zip(atom.value, t.value, strict=True))
    x, y = numeral(t.value), numeral(atom.value)
    return x is not None and y is not None and {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[atom.op]


def naive(items, query):
    hide = HideConfig.from_tags(t for ts in items.values() for t in ts)
    open_ = hide.unrevealed(map(reference_of, query.atoms))
    universe = {i for i, ts in items.items() if any(not any(p.covers(t.ns, t.key) for p in open_) for t in ts)}
    stack = []
    for step in query.program:
        if isinstance(step, Atom):
            own = hide.unrevealed([reference_of(step)])
            stack.append({i for i, ts in items.items() if any(tag_answers(step, t) and not any(p.covers(t.ns, t.key) for p in own) for t in ts)})
        elif step == NOT:
            stack.append(universe - stack.pop())
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(a & b if step == "and" else a | b)
    return sorted(stack[0], key=lambda s: s.encode())


def random_query(rng, depth=0):
    if depth < 3 and rng.random() < 0.6:
        kind = rng.choice(["and", "or", "not"])
        if kind == "not":
            return f"not ({random_query(rng, depth + 1)})"
        return f"({random_query(rng, depth + 1)} {kind} {random_query(rng, depth + 1)})"
    ns = rng.choice(["", "", "*:", "+:", "n:", "n.m:", '"":'])
    op = rng.choice(["", "=1", "!=1", ">1", "<=2", "~\".\"", "=*", "=+", '=""', "~1%", ">x"])
    return ns + rng.choice(["a", "b", "c", "*"]) + (op if "%" not in op else '~"1%"')


def test_plans_agree_with_the_plain_evaluator(spark):
    rng = random.Random(5)
    for _ in range(6):
        items = {}
        for i in range(12):
            n = rng.randint(0, 4)
            items[f"i{i}é" if i % 5 == 0 else f"i{i}"] = [
                Tag(rng.choice([None, None, "n", "n.m", "nn", ""]), rng.choice("abc"), rng.choice([None, "", "1", "2", "+1", "x", "1%", "10"])) for _ in range(n)
            ]
        for target in rng.sample(["n:*", "n:a", "*:b", "c", "n.m:c"], 2):
            items[f"cfg{target}"] = [Tag(HIDE_NS, target, rng.choice(["true", "false"]))]
        rows = [(i, t.ns, t.key, t.value) for i, ts in items.items() for t in ts]
        tags = spark.createDataFrame(rows + rows[:3], TAGS).cache()
        long, nested = TagStore.from_tags(tags), TagStore.from_nested(to_nested(tags, spark.createDataFrame([(i,) for i in items], "id string")).cache())
        for _ in range(5):
            q = compile_query(random_query(rng))
            want = naive(items, q)
            assert ids(long.run(q, "fused")) == want, q.postfix
            assert ids(long.run(q, "posting")) == want, q.postfix
            assert ids(nested.run(q)) == want, q.postfix
        twice = compile_query("not not (" + random_query(rng) + ")")
        once = type(twice)("", twice.program[:-2])
        assert ids(long.run(twice)) == ids(long.run(once))


def test_live_tags_match_a_replay(spark):
    rng = random.Random(7)
    for _ in range(4):
        log, live, scalar = [], {}, set()
        for seq in range(40):
            item, before = rng.choice("xyz"), set(scalar)
            for pos in range(rng.randint(1, 3)):
                if rng.random() < 0.06:
                    t = (f"{ROOT_NS}.arity", rng.choice(["a", "n:a", "b"]), rng.choice(["scalar", "set"]))
                    if t[2] == "scalar":
                        scalar.add(t[1])
                else:
                    t = (rng.choice([None, "n"]), rng.choice("ab"), rng.choice([None, "1", "2", "3"]))
                log.append((seq, pos, item, *t))
                target = t[1] if t[0] is None else f"{t[0]}:{t[1]}"
                values = live.setdefault((item, t[0], t[1]), set())
                if target in before:
                    values.clear()
                values.add(t[2])
        rng.shuffle(log)
        got = {tuple(r) for r in live_tags(spark.createDataFrame(log + log[:9], WRITES)).collect()}
        assert got == {(*k, v) for k, vs in live.items() for v in vs}


def test_many_atoms(spark):
    store = TagStore.from_tags(spark.createDataFrame([(f"i{k}", None, "k", str(k)) for k in range(400)], TAGS))
    query = " or ".join(f"k={k}" for k in range(0, 400, 2))
    want = sorted(f"i{k}" for k in range(0, 400, 2))
    assert ids(store.query(query)) == want and ids(store.query(query, "nested")) == want
    assert ids(store.query(" ".join(f"not k={k}" for k in range(0, 400, 2)), "nested")) == sorted(f"i{k}" for k in range(1, 400, 2))


def test_edges(spark):
    empty = TagStore.empty(spark)
    assert ids(empty.query("not a")) == [] and ids(empty.all_ids()) == []
    store = TagStore.from_tags(spark.createDataFrame([(None, None, "a", "1"), ("x", None, "a", "1"), ("x", None, "a", "1"), ("y", "n", "b", None)], TAGS))
    for strategy in ANY_STORE:
        assert ids(store.query("*:*", strategy)) == ["x", "y"]
        assert ids(store.query("not a", strategy)) == ["y"]
    wide = spark.createDataFrame([("x", None, "k", "v", 1, "other")], "id string, ns string, key string, value string, m0 int, tags string")
    assert ids(TagStore.from_tags(wide).query("k and not j")) == ["x"]
    nested = spark.createDataFrame([("x", None), ("y", [(None, "k", None)]), ("z", [])], "id string, tags array<struct<ns:string,key:string,value:string>>")
    assert ids(TagStore.from_nested(nested).query("*:*")) == ["y"] and ids(TagStore.from_nested(nested).all_ids()) == ["x", "y", "z"]


def test_hide_config(spark):
    store = TagStore.empty(spark)
    store.add_line(f'cfg {HIDE_NS}:"n:*"=true {HIDE_NS}:k=maybe')
    store.add_line("x n.m:a k n2:b")
    cfg = store.hide_config()
    assert cfg == HideConfig.from_patterns([f"{ROOT_NS}:*", "n:*"]) or cfg == HideConfig.from_patterns(["n:*", f"{ROOT_NS}:*"])
    assert cfg.tag_hidden(Tag("n.m", "a", None)) and not cfg.tag_hidden(Tag("n2", "a", None)) and not cfg.tag_hidden(Tag(None, "k", None))
    assert {(r.ns, r.key) for r in store.displayed().collect()} == {(None, "k"), ("n2", "b")}
    assert ids(store.participating()) == ["x"] and ids(store.participating(f"{ROOT_NS}.hide:*")) == ["cfg", "x"]


def test_python_comparator(spark):
    store = TagStore.empty(spark)
    store.register_type("length", lambda a, b: None if "!" in a else (len(a) > len(b)) - (len(a) < len(b)))
    store.add_line(f"cfg {ROOT_NS}.type:v=length")
    store.add_line('x v=abc v="a!b"')
    store.add_line("y v=a v")
    for strategy in ANY_STORE:
        assert ids(store.query("v>ab", strategy)) == ["x"] and ids(store.query("v<=ab", strategy)) == ["y"]


def test_comparator_keys(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(v,) for v in ["1.2", "+1.2", "18446744073709551615", "18446744073709551616", "1..2", "", "1.x", "007"]], "v string")
    got = {r.v: r.k for r in rows.select("v", VERSION.sort_key(F.col("v")).alias("k")).collect()}
    assert got["1.2"] == got["+1.2"] and got["007"] == [7] and got["18446744073709551615"] is not None
    assert all(got[v] is None for v in ["18446744073709551616", "1..2", "", "1.x"])
    sem = spark.createDataFrame([(v,) for v in ["1.2.3", "1.2", "1.2.3-", "1.2.3-a..b", "1.2.3-é", "1.2.3-01", "1.2.3-a+b+c"]], "v string")
    got = {r.v: r.ok for r in sem.select("v", SEMVER.sort_key(F.col("v")).isNotNull().alias("ok")).collect()}
    assert got["1.2.3"] and got["1.2.3-a+b+c"] and not any(got[v] for v in ["1.2", "1.2.3-", "1.2.3-a..b", "1.2.3-é"])


def test_long_layout_prunes(spark, tmp_path):
    rows = [(f"i{k}", None if k % 3 else "n", f"k{k % 7}", str(k)) for k in range(200)] + [("e", "", "k1", "")]
    tags = spark.createDataFrame(rows, TAGS)
    write_long(tags, str(tmp_path / "t"), buckets=8, files_per_bucket=2)
    back = read_long(spark, str(tmp_path / "t"))
    assert sorted(map(str, to_long(to_nested(back)).collect())) == sorted(map(str, tags.collect()))
    store = TagStore.from_tags(back)
    df = store.query("n:k3>50", "posting")
    assert ids(df) == sorted(i for i, n, k, v in rows if n == "n" and k == "k3" and float(v or 0) > 50)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "tag_bucket" in plan and "PartitionFilters: [isnotnull(tag_bucket" in plan
    assert ids(store.query('"":k1=""')) == ["e"]


def test_tables_as_stores(spark, tmp_path):
    from pyspark.sql import functions as F

    from tagloom.sources.tables import TagColumns, TagOf, number_tag

    rng = random.Random(3)
    rows = [(k, rng.choice(["x", "y", None]), rng.choice([None, -1.5, 0.0, 12345678.9]), rng.choice([True, False, None])) for k in range(60)]
    spark.createDataFrame(rows, "k int, a string, n double, f boolean").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    specs = [TagOf("a", F.col("a")), number_tag("n", "n", "num"), TagOf("flag", when=F.col("f")), TagOf("a", F.col("a"), "copy", when=F.col("f"))]
    one, many = (TagColumns(df, F.concat(F.lit("r"), m), specs, o) for m, o in ((F.col("k").cast("string"), True), ((F.col("k") % 7).cast("string"), False)))
    for tables in ([one], [many], [one, many]):
        store, long = TagStore.from_columns(*tables), TagStore.from_tags(reduce_union(tables))
        for q in ["a=x", "flag and not a=y", "not (a or flag)", "*:a=x and num:n<0", "not flag", "*:*", "copy:*", "num:n>1 or not copy:a=x", "not not a!=x", "not a=x and not a=y"]:
            assert ids(store.query(q)) == ids(long.query(q)) == ids(store.query(q, "posting")), q
    asked = TagStore.from_columns(one).query("a=x and not flag", ordered=False)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(a,x)" in plan and plan.count("Exchange") == 1 and "n#" not in plan.split("ReadSchema")[1]
    assert sorted(ids(asked), key=str.encode) == ids(TagStore.from_columns(one).query("a=x and not flag"))
    with pytest.raises(ValueError):
        long.query("a", "columns")


def reduce_union(tables):
    first, *rest = [t.long() for t in tables]
    for t in rest:
        first = first.unionByName(t)
    return first


def test_atoms_on_their_own(spark):
    from pyspark.sql import functions as F

    from tagloom import parse_atom
    from tagloom.functions.predicates import atom_matches
    from tagloom.model import NESTED

    rng = random.Random(11)
    values = [None, "", "1", "+1", "-0", "0", "1.5", "1e5", "5\n", "x", "a_b", "50%", "9" * 400]
    rows = [(f"i{k}", None if k == 0 else [(rng.choice([None, "", "n"]), rng.choice("kj"), rng.choice(values)) for _ in range(k % 4)]) for k in range(80)]
    df = spark.createDataFrame(rows, NESTED).cache()
    for text in ["k", "*:k", "+:*", '"":k', "n:j=+", "k=*", "k>*", "k=1", "k!=1", "k>=1", "k<1", "k<=0", 'k~"..."', "k~a_b", 'k~"5."', 'k="5\n"', "k>-1", "*:*<2"]:
        atom = parse_atom(text)
        got = {r.id for r in df.filter(atom_matches(atom, F.col("tags"))).collect()}
        assert got == {i for i, tags in rows if atom.matches(Tag(*t) for t in tags or [])}, text
        assert got == {i for i, tags in rows if any(tag_answers(atom, Tag(*t)) for t in tags or [])}, text


def test_parse_tag_matches_facade():
    from tagloom.index import compile, parse_tag as facade

    assert facade("a:b") == {"namespace": "a", "key": "b", "value": None} and compile("a b") == "a/b/and"
    assert parse_tag("a:b") == Tag("a", "b", None)
