import os
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.config import arity_ns, hide_ns
from tagloom.model import NESTED, TAGS, WRITES
from tagloom.operators import hot_keys, reject, tokenizer, wide
from tagloom.operators.collapse import live_tags
from tagloom.sources import lines as L


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# 1: per-key profile


def brute_profile(writes):
    seen = defaultdict(lambda: [0, set(), set()])
    for _, _, i, ns, key, value in writes:
        for grain, name in (("ns", ns if ns is not None else "-"), ("key", key), ("attr", key if ns is None or key is None else f"{ns}:{key}")):
            if name is not None:
                s = seen[grain, name]
                s[0] += 1
                s[1] |= {i} - {None}
                s[2] |= {value} - {None}
    return sorted(((*k, v[0], len(v[1]), len(v[2])) for k, v in seen.items()), key=str)


@pytest.mark.parametrize("chunk", [1, 2, 7, 1000])
def test_key_profile(spark, chunk):
    rng = random.Random(chunk)
    rows = [
        (k, 0, rng.choice(["a", "b", None, "", *[f"i{n}" for n in range(40)]]), rng.choice([None, None, "n", "-", ""]), rng.choice(["hot"] * 9 + ["k1", "k2", None]), rng.choice([None, "", "v", str(k % 50)]))
        for k in range(900)
    ]
    rows += rows[:50]
    df = spark.createDataFrame(rows, WRITES).repartition(5)
    assert rows_of(hot_keys.key_profile(df, chunk)) == brute_profile(rows)
    line = hot_keys.lined_up(df).collect()
    assert sorted(r["at"] for r in line) == list(range(len(line)))
    ordered = [(r.line, r.name, r.kind, (r.member is not None, r.member or ""), (r.ns is not None, r.ns or "")) for r in sorted(line, key=lambda r: r["at"])]
    assert ordered == sorted(ordered)
    # Chunks are cut at equal offsets, and at names.
    states = [s["at"] for s in hot_keys.chunk_states(df, chunk).filter("grain != 'attr'").collect()]
    assert set(range(0, len(line), chunk)) <= set(states) and len(states) == len(set(states))


def test_names_that_look_alike(spark):
    rows = [(k, 0, f"i{k % 7}", *rng, "v") for k, rng in enumerate([(None, "a:b:c"), ("a", "b:c"), ("a:b", "c"), ("-", "c"), (None, "c")] * 20)]
    assert rows_of(hot_keys.key_profile(spark.createDataFrame(rows, WRITES), 3)) == brute_profile(rows)


def test_a_hot_name_comes_through_numbers_and_merge(spark):
    """Nothing of the method is pruned from the query that asks for counts only."""
    df = spark.createDataFrame([(k, 0, f"i{k}", "n", "k", str(k % 3)) for k in range(50)], WRITES)
    plan = hot_keys.hot_keys(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Window" in plan and "offset" in plan and "members" in plan and "first" in plan


def test_key_profile_edges(spark):
    empty = spark.createDataFrame([], WRITES)
    assert rows_of(hot_keys.key_profile(empty)) == [] and rows_of(hot_keys.hot_keys(empty)) == []
    odd = spark.createDataFrame([(1, 0, "x", None, None, None, 5, "g")] * 3, "seq bigint, pos int, id string, ns string, key string, value string, n int, grain string")
    assert rows_of(hot_keys.key_profile(odd)) == [("ns", "-", 3, 1, 0)]
    one = [(k, 0, f"i{k}", "n", "k", "v" * 100_000 if k == 0 else None) for k in range(94)] + [(k, 0, "z", "m", "j", None) for k in range(6)]
    assert set(rows_of(hot_keys.hot_keys(spark.createDataFrame(one, WRITES)))) == {(g, n) for g, a, b in (("ns", "n", "m"), ("key", "k", "j"), ("attr", "n:k", "m:j")) for n in (a, b)}


# 4: wide tables

CATALOG = [
    (1, None, "rank", "rank_no", "bigint", False), (2, "geo", "lat", "lat", "double", False), (3, None, "due", "due_on", "date", False),
    (4, "sys", "seen", "seen_at", "timestamp", False), (5, None, "ok", "ok", "boolean", False), (6, None, "name", "name", "string", False),
    (7, None, "topic", "topics", "string", True), (8, "", "rank", "sizes", "bigint", True),
]
CATALOG_SCHEMA = "attr_id bigint, ns string, key string, col_name string, col_type string, many boolean"


@pytest.mark.parametrize(
    "kind,good,bad",
    [
        ("bigint", {"5": 5, "+05": 5, "-7": -7, "9223372036854775807": 2**63 - 1}, ["", " 5", "5 ", "5\n", "5.0", "1e3", "9223372036854775808", "٣", "--5", "+"]),
        ("double", {"5": 5.0, "+1.50": 1.5, "-0.0": 0.0}, ["", ".5", "5.", "1e5", "NaN", "inf", "5d", "1,5", "−5", "\t5"]),
        ("boolean", {"TRUE": True, "false": False}, ["", "t", "1", "yes", "true ", "truee"]),
        ("date", {"2028-02-29": "2028-02-29"}, ["2027-02-29", "2027-13-01", "2027-1-1", "2027-01-01 ", "20270101", "2027-01-01Z"]),
        ("timestamp", {"2027-12-13T12:00:48Z": "2027-12-13 12:00:48", "2027-01-01T00:30:00+01:00": "2026-12-31 23:30:00"}, ["2027-12-13T24:00:00Z", "2027-12-13T12:00:48", "2027-12-13t12:00:48z", "2027-02-30T00:00:00Z", "2027-12-13T12:00:60Z", "2027-12-13 12:00:48Z"]),
        ("string", {"": "", " x ": " x "}, []),
    ],
)
def test_readers(spark, kind, good, bad):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string")
    got = {r.t: r.v for r in df.select("t", wide.typed(kind, wide.canonical(F.lit(kind), F.col("t"))).alias("v")).collect()}
    for text, value in good.items():
        assert str(got[text]) == str(value), text
    assert [t for t in bad if got[t] is not None] == []


def test_widen(spark):
    tags = [
        ("a", None, "rank", "5"), ("a", None, "rank", "+5"), ("a", "geo", "lat", "x"), ("a", None, "due", "2027-01-01"), ("a", None, "due", "2027-01-02"),
        ("a", None, "topic", "t2"), ("a", None, "topic", "t1"), ("a", None, "topic", "t1"), ("a", "", "rank", "1"), ("a", "", "rank", "x"),
        ("a", "sys", "seen", "2027-01-01T01:00:00+01:00"), ("a", "sys", "seen", "2027-01-01T00:00:00Z"), ("b", None, "name", None), ("b", None, "ok", "True"),
        ("b", None, "ok", "maybe"), ("b", None, "topic", None), ("b", "geo", "rank", "9"), ("ghost", None, "rank", "1"), (None, None, "rank", "1"), ("d", None, "name", ""),
    ]
    items = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("c", 3), (None, 4), ("d", 1)], "id string, of int")
    catalog = spark.createDataFrame(CATALOG, CATALOG_SCHEMA)
    got = {r.id: r for r in wide.widen(spark.createDataFrame(tags, TAGS), items, catalog).collect()}
    assert set(got) == set("abcd")
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.rank_no, a.lat, a.due_on, a.topics, a.sizes, str(a.seen_at)) == (5, None, None, ["t1", "t2"], [1], "2027-01-01 00:00:00")
    assert {k: (v.reason, v.n_rows, v.n_unread) for k, v in a.failed.items()} == {"lat": ("unreadable", 1, 1), "due_on": ("conflict", 2, 0), "sizes": ("partly", 2, 1)}
    assert b.ok is True and b.name is None and b.topics is None
    assert {k: v.reason for k, v in b.failed.items()} == {"name": "unreadable", "ok": "partly", "topics": "unreadable"}
    assert c.rank_no is None and not c.failed and got["d"].name == ""
    found = wide.failed_cells(spark.createDataFrame(tags, TAGS), items, catalog)
    assert rows_of(found) == [("a", "due_on"), ("a", "lat"), ("b", "name")]
    assert rows_of(wide.failed_cells(spark.createDataFrame([], TAGS), items.limit(0), catalog)) == []


@pytest.mark.parametrize("extra", [(9, None, "x", "id", "string", False), (9, None, "x", "LAT", "string", False), (9, None, "x", "x", "blob", False), (9, None, "x", "failed", "string", False)])
def test_catalogues_refused(spark, extra):
    with pytest.raises(ValueError):
        wide.read_catalog(spark.createDataFrame([*CATALOG, extra], CATALOG_SCHEMA))


# 5: rows that fail to parse

WHITE = "\t\n\x0b\x0c\r \x85\xa0      　"
BARE = re.compile(r"(?!\+\Z)[A-Za-z0-9_+\-][A-Za-z0-9_.+\-]*")


def of_texts(parse, texts):
    return parse(pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())).to_pylist()


def test_stretches_of_texts():
    texts = pa.array(["zz", 'aé漢\U0001f600"x""y"', None, "", 'é"'])
    for column in (texts, texts.slice(1), texts.slice(1, 3)):
        laid = tokenizer.Texts(column)
        whole = "".join(t or "" for t in column.to_pylist())
        assert "".join(map(chr, laid.chars)) == whole and laid.lengths.tolist() == [len(t or "") for t in column.to_pylist()]
        a, b = np.array([0, 1, 3, len(whole)]), np.array([2, 1, 7, len(whole)])
        assert laid.take(a, b).to_pylist() == [whole[x:y] for x, y in zip(a, b)]
    laid = tokenizer.Texts(pa.array(['"x""y"b']))
    assert laid.tokens(np.array([0, 6, 0]), np.array([6, 7, 6]), np.array([True, True, False])).to_pylist() == ['x"y', "b", None]


def test_numbers_too_long_are_kept(spark):
    """pos is a 64-bit number; what doesn't fit is told, not lost."""
    raw = ["5,1234567890,a,,k,v", f"{2**63 - 1},{2**63 - 1},a,,k,v", f"000{2**63},0,a,,k,v", f'"7","{10**30}",a,n,k,', "12345678901234567890123,00012345678901234567890123,a,,k,"]
    rows = {r.row_no: r for r in reject.load_export(spark.createDataFrame(list(enumerate(raw)), "row_no bigint, raw string")).collect()}
    assert all(r.reason is None and r.key == "k" for r in rows.values())
    assert [(rows[k].seq, rows[k].pos) for k in range(5)] == [(5, 1234567890), (2**63 - 1, 2**63 - 1), (None, 0), (7, None), (None, None)]
    assert [rows[k].overlong for k in range(5)] == [None, None, f"seq={2**63}", f"pos={10**30}", "seq=12345678901234567890123 pos=12345678901234567890123"]


def brute_line(text):
    fields, now, quoted = [], "", False
    for c in text or "":
        quoted ^= c == '"'
        if c in WHITE and not quoted:
            fields, now = fields + [now] * bool(now), ""
        else:
            now += c
    fields += [now] * bool(now)
    if not fields:
        return None
    if quoted:
        return "quoting"
    found = set()
    for field in fields[1:]:
        parts, equals, colons = [""], 0, 0
        for c in field:
            quoted ^= c == '"'
            if not quoted and (c == "=" or c == ":" and not equals):
                equals, colons = equals + (c == "="), colons + (c == ":")
                parts.append("")
            else:
                parts[-1] += c
        found |= {"columns"} if equals > 1 or colons > 1 else set()
        for p in parts:
            if '"' in p:
                found |= set() if re.fullmatch('"(?:[^"]|"")*"', p) else {"quoting"}
            elif not BARE.fullmatch(p):
                found.add("value")
    return next((r for r in reject.REASONS if r in found), "")


def brute_record(text):
    rest, fields = text or "", []
    while True:
        m = re.match('"(?:[^"]|"")*"|[^",][^",]*|', rest, re.S)
        fields.append(m.group())
        rest = rest[m.end() :]
        if not rest:
            break
        if rest[0] != ",":
            return "quoting"
        rest = rest[1:]
    if len(fields) != 6:
        return "columns"
    seq, pos, i, ns, key, value = (None if f == "" else f[1:-1].replace('""', '"') if f[0] == '"' else f for f in fields)
    blank = lambda s: all(c in WHITE for c in s)
    if not re.fullmatch("[0-9]+", seq or "") or not int(seq) or not re.fullmatch("[0-9]+", pos or "") or not i or not key or blank(key) or ns and blank(ns):
        return "value"
    return "value" if any("�" in (x or "") for x in (seq, pos, i, ns, key, value)) else ""


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='ab=:"+.* 　\x1cé', max_size=30), max_size=6))
def test_lines_against_brute_force(texts):
    rows = of_texts(reject.parse_lines, texts)
    reasons = {r["row_no"]: r["reason"] or "" for r in rows}
    assert reasons == {i: brute_line(t) for i, t in enumerate(texts) if brute_line(t) is not None}
    assert all(0 <= r["at"] <= len(texts[r["row_no"]]) for r in rows if r["reason"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='1a,,,"\n �', max_size=24), max_size=6), st.lists(st.sampled_from(['1', '0', '"x"', '"a""b"', "", '""', " ", "x�", '"1"']), min_size=6, max_size=6))
def test_records_against_brute_force(texts, fields):
    texts = [*texts, ",".join(fields), None]
    got = {r["row_no"]: r["reason"] or "" for r in of_texts(reject.parse_records, texts)}
    assert got == {i: brute_record(t) for i, t in enumerate(texts)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet='a," ', max_size=40), max_size=5), st.sampled_from([1, 2, 3, 5, 64]))
def test_chunks_compose(texts, chunk):
    laid = tokenizer.Texts(pa.array(texts, pa.string()))
    chars, lengths = laid.chars, laid.lengths
    for machine, separators in ((tokenizer.RECORD, tokenizer.COMMA), (tokenizer.LINE, tokenizer.WHITE)):
        classes = tokenizer.classify(chars, separators)
        before, ends = machine.run(classes, lengths, chunk)
        at, want = 0, []
        for n, end in zip(lengths, ends, strict=True):
            state = 0
            for c in classes[at : at + n]:
                want.append(state)
                state = machine.table[state, c]
            assert state == end
            at += n
        assert before.tolist() == want


def test_one_long_line():
    text = 'x k="' + 'a ""b' * 100_000 + '" ns:k=v'
    rows = of_texts(reject.parse_lines, [text])
    assert [r["pos"] for r in rows] == [0, 1] and rows[0]["value"] == 'a "b' * 100_000
    assert of_texts(reject.parse_lines, [text + '"'])[0]["reason"] == "quoting"


def test_rejected_and_loaded(spark):
    lines = spark.createDataFrame([(1, "x k=1 n:j"), (1, "x k=1 n:j"), (2, "x =1"), (2, "x =1"), (3, " 　"), (4, None), (5, 'x "k'), (6, "only"), (None, "x :")], "seq bigint, value string")
    export = spark.createDataFrame([(1, '7,0,x,,k,""'), (2, "7,0,x"), (3, None), (4, '99999999999999999999,0,x,n,k,')], "row_no bigint, raw string")
    assert rows_of(reject.rejected(lines, export)) == rows_of(
        spark.createDataFrame([("lines", 2, "value"), ("lines", 5, "quoting"), ("lines", None, "value"), ("export", 2, "columns"), ("export", 3, "columns")], "src string, row_no bigint, reason string")
    )
    assert {tuple(r) for r in reject.loaded_tags(lines, export).collect()} == {
        ("lines", 1, 0, "x", None, "k", "1"), ("lines", 1, 1, "x", "n", "j", None), ("export", 1, 0, "x", None, "k", ""), ("export", 4, 0, "x", "n", "k", None),
    }
    assert rows_of(reject.rejected(lines.limit(0), export.limit(0))) == []


# Sources


def test_native_ingest_agrees_with_the_tokenizer(spark, sf):
    raw = spark.read.parquet(f"{sf}/tag_lines.parquet")
    native = {tuple(r) for r in L.to_writes(L.parse_lines(raw, "dropmalformed")).collect()}
    loaded = {(r.row_no, r.pos, r.id, r.ns, r.key, r.value) for r in reject.load_lines(raw).filter("reason IS NULL AND key IS NOT NULL").collect()}
    assert native == loaded


def test_line_modes(spark):
    df = spark.createDataFrame([(1, 'a k="x y" n:j'), (2, "b =1"), (3, "  "), (4, 'c "open'), (5, "d"), (6, None)], "seq bigint, value string")
    got = {r.seq: r for r in L.parse_lines(df, "permissive").collect()}
    assert set(got) == {1, 2, 4, 5} and got[1].tags[0].value == "x y" and got[5].tags == [] and got[2].id is None and got[2]._corrupt == "b =1" and got[4]._corrupt
    assert {r.seq for r in L.parse_lines(df, "dropmalformed").collect()} == {1, 5}
    with pytest.raises(Exception, match="bad line"):
        L.parse_lines(df).collect()
    with pytest.raises(ValueError):
        L.parse_lines(df, "loud")


def test_long_quoted_value_in_the_jvm(spark):
    df = spark.createDataFrame([(1, 'a k="' + 'x""' * 100_000 + '"')], "seq bigint, value string")
    assert len(L.parse_lines(df).first().tags[0].value) == 200_000


def test_files_round_trip(spark, tmp_path):
    nested = spark.createDataFrame(
        [("a", [(None, "k", 'say "x" y'), ("", "j", None), ("n", "+", "")]), ("b", []), ("c", None), ("d", [(None, "é", "　")])], NESTED
    )
    back = L.parse_lines(L.to_lines(nested).selectExpr("monotonically_increasing_id() AS seq", "value"))
    assert {r.id: [tuple(t) for t in r.tags] for r in back.collect()} == {r.id: [tuple(t) for t in r.tags or []] for r in nested.collect()}
    with pytest.raises(Exception, match="no id"):
        L.to_lines(spark.createDataFrame([("a b", [])], NESTED)).collect()
    L.write_jsonl(nested, str(tmp_path / "j"))
    assert rows_of(L.read_jsonl(spark, str(tmp_path / "j"))) == rows_of(nested)
    (tmp_path / "t").mkdir()
    for name, text in (("1.txt", "a k=1\nb k=2\n"), ("2.txt", "a k=3\n")):
        (tmp_path / "t" / name).write_text(text)
    assert [(r.seq, r.value) for r in L.read_text(spark, str(tmp_path / "t")).orderBy("seq").collect()] == [(0, "a k=1"), (1, "b k=2"), (2, "a k=3")]
    L.write_ids(spark.createDataFrame([("b",), ("a",)], "id string"), str(tmp_path / "ids"))
    assert [r.value for r in spark.read.text(str(tmp_path / "ids")).orderBy("value").collect()] == ["a", "b"]
    assert L.joined_ids(spark.createDataFrame([("b",), ("a",)], "id string")) == "a\nb"


def test_cli(spark, capsys):
    import io

    from tagloom.cli import main

    def run(*args, lines=()):
        out = io.StringIO()
        return main(list(args), lines, out, spark), out.getvalue()

    data = ["a urgent lang=en status=done\n", "\n", "b lang=en\n", "c urgent=false\n"]
    assert run("parse", "geo:lat=57.64") == (0, "namespace: geo\nkey: lat\nvalue: 57.64\n")
    assert run("parse", "urgent") == (0, "key: urgent\n") and run("parse", "ns:*=5") == (1, "")
    assert run("compile", "a or b and c") == (0, "a/b/c/and/or\n") and run("compile", "a and")[0] == 1
    assert run("query", "lang=en", lines=data) == (0, "a\nb\n")
    assert run("query", "--postfix", "urgent/status=done/not/and", lines=data) == (0, "c\n")
    assert run("query", "urgent", lines=["a =5\n"]) == (1, "") and run("query", "a and", lines=data)[0] == 1
    assert run()[0] == 2 and run("bogus")[0] == 2 and run("query")[0] == 2


def test_index_facade(spark):
    from tagloom.index import Index

    i = Index(spark)
    i.add("a k=1")
    i.add("b k=2 k=1")
    assert i.query("k=1 and not k=2") == ["a"] and i.query_postfix("k=1/k=2") == ["b"]
    with pytest.raises(ValueError):
        i.add("c =1")


# Streams


def test_streams(spark, tmp_path):
    from tagloom.streaming import ingest

    source = str(tmp_path / "in")
    first = [(1, f"cfg {arity_ns()}:k=scalar"), (2, "a k=1 j=1"), (3, "b k=2"), (9, "c =bad")]
    spark.createDataFrame(first, "seq bigint, value string").write.parquet(source)
    stream = spark.readStream.schema("seq bigint, value string").parquet(source)
    answers = {}

    def sink(df, n):
        answers[n] = [r.id for r in df.collect()]

    def ask(*lines):
        spark.createDataFrame(lines, "seq bigint, value string").write.mode("append").parquet(source)
        ingest.standing_query(ingest.writes_of(stream), str(tmp_path / "log"), "j and not k=1", sink, str(tmp_path / "c1")).awaitTermination()

    ask()
    # Later batches bring a newer value and a late one, and a row again.
    ask((5, "a k=7"), (4, "a k=6"), (3, "b k=2"))
    ask((6, "c j=2"), (7, "d j=2 k=1"))
    # The old answer goes on; items that aren't touched aren't asked again.
    ask((8, "c k=1"))
    assert answers == {0: [], 1: ["a"], 2: ["a", "c"], 3: ["a"]}
    # A setting concerns all items: hidden tags make no item answer.
    ask((20, f"cfg {hide_ns()}:j=true"), (21, "e j=1"))
    ask((22, "f j=1 k=2"))
    assert answers[4] == ["a", "e"] and answers[5] == ["a", "e", "f"]
    ingest.append_log(ingest.writes_of(stream), str(tmp_path / "plain"), str(tmp_path / "c2")).awaitTermination()
    log = L.read_writes(spark, str(tmp_path / "plain"))
    assert {(r.id, r.key, r.value) for r in live_tags(log).collect() if r.id in "ab"} == {("a", "k", "7"), ("a", "j", "1"), ("b", "k", "2")}
    latest = ingest.latest_values(ingest.writes_of(stream), log).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    latest.awaitTermination()
    assert {(r.id, r.value, r.seq) for r in spark.table("latest").collect() if r.id in "ab"} == {("a", "7", 5), ("b", "2", 3)}


def test_tokenizer_of_nothing():
    assert of_texts(reject.parse_lines, []) == of_texts(reject.parse_records, []) == []
    before, ends = tokenizer.LINE.run(np.zeros(0, np.uint8), np.array([0, 0]))
    assert len(before) == 0 and ends.tolist() == [0, 0]


# Partitions


def test_ranges_grow_with_the_data(spark, tmp_path):
    from tagloom import sizing

    path = str(tmp_path / "t")
    spark.range(200_000).selectExpr("id", "uuid() AS u").write.parquet(path)
    df = spark.read.parquet(path)
    assert sizing.partitions_for(df) is None and sizing.partitions_for(df.limit(0)) is None
    assert sizing.partitions_for(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a int")) is None
    n = sizing.partitions_for(df, 100_000)
    assert n > 40
    few = sizing.by_range(df, "id")
    assert few.count() == 200_000 and few.rdd.getNumPartitions() <= 4


# Checkpoints


def test_checkpoints_need_a_shared_folder(spark):
    from types import SimpleNamespace as N

    from tagloom import checkpoints

    def session(master, conf):
        said = {}
        sc = N(master=master, getCheckpointDir=lambda: said.get("dir"), setCheckpointDir=lambda d: said.update(dir=d), getConf=lambda: N(get=conf.get))
        return N(sparkContext=sc)

    with pytest.raises(ValueError):
        checkpoints.folder(session("spark://host:7077", {}))
    assert checkpoints.folder(session("spark://host:7077", {"spark.checkpoint.dir": "file:///shared"})) == "file:///shared"
    assert "tagloom-" in checkpoints.folder(session("local[2]", {}))
    df = spark.createDataFrame([(1, ["x"]), (2, None)], "a int, b array<string>")
    assert rows_of(checkpoints.saved(df)) == rows_of(df) == rows_of(checkpoints.cut(df))
    assert checkpoints.saved(df.limit(0)).count() == 0
    # A scope deletes its own tables, and no other.
    outer = checkpoints.saved(df)
    with checkpoints.scope():
        inner = checkpoints.saved(df)
        files = [f.removeprefix("file://") for f in inner.inputFiles()]
        assert inner.count() == 2 and all(map(os.path.exists, files))
    assert outer.count() == 2 and files and not any(map(os.path.exists, files))
