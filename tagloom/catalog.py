"""Queries by name over the driver's tables, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.checkpoints import saved, scratch
from tagloom.config import ROOT_NS, HideConfig, arity_ns, hide_ns, type_ns
from tagloom.functions.comparators import SEMVER, VERSION
from tagloom.functions.predicates import atom_matches, hidden
from tagloom.model import QueryError, Tag
from tagloom.operators import hot_keys, reject, wide
from tagloom.operators.collapse import live_tags
from tagloom.sources import lines as line_source
from tagloom.parse import compile_infix, compile_postfix, parse_atom
from tagloom.sources.layout import read_long, to_long, to_nested, write_long
from tagloom.sources.tables import TagColumns, TagOf, number_tag
from tagloom.store import TagStore, settings_root

HIDE, ARITY, TYPE = hide_ns(), arity_ns(), type_ns()


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_roots: dict[str, str] = {}


def root_of(spark: SparkSession, d: str) -> str:
    """The root of the settings that the tables of a directory hold."""
    if d not in _roots:
        _roots[d] = settings_root(table(spark, d, "tags"))
    return _roots[d]


def order_items(spark: SparkSession, d: str) -> TagColumns:
    return TagColumns(
        table(spark, d, "orders"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")),
        [
            TagOf("status", F.col("o_orderstatus")),
            TagOf("priority", F.col("o_orderpriority")),
            number_tag("total", "o_totalprice", "order"),
            TagOf("due", F.date_format("o_orderdate", "yyyy-MM-dd")),
            TagOf("urgent", when=F.col("o_orderpriority") == "1-URGENT"),
        ],
        one_row=True,
    )


def lineitem_tags(spark: SparkSession, d: str) -> TagColumns:
    return TagColumns(
        table(spark, d, "lineitem"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")),
        [
            TagOf("flag", F.col("l_returnflag")),
            TagOf("status", F.col("l_linestatus"), "line"),
            number_tag("qty", "l_quantity", "line"),
            TagOf("ship", F.date_format("l_shipdate", "yyyy-MM-dd")),
        ],
    )


def event_tags(spark: SparkSession, d: str) -> TagColumns:
    return TagColumns(
        table(spark, d, "events"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")),
        [TagOf("event", F.col("event_type")), number_tag("value", "value", "ev"), TagOf("errored", when=F.col("event_type") == "error")],
    )


def document_items(spark: SparkSession, d: str) -> TagColumns:
    return TagColumns(
        table(spark, d, "documents"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")),
        [TagOf("lang", F.col("lang")), TagOf("source", F.col("source")), TagOf("chars", F.col("n_chars").cast("string"), "meta")],
        one_row=True,
    )


def part_items(spark: SparkSession, d: str) -> TagColumns:
    number = lambda n: (F.col("p_partkey") % n).cast("string")
    version = F.concat_ws(".", F.col("p_size").cast("string"), number(20))
    # Pre-releases of one version: numbered ones, named ones, and named ones with a number.
    stage = F.element_at(F.array(number(12), F.lit("beta"), F.concat(F.lit("beta."), number(12)), F.lit("alpha-1")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return TagColumns(
        table(spark, d, "part"),
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")),
        [TagOf("brand", F.col("p_brand")), TagOf("size", F.col("p_size").cast("string")), TagOf("ver", version), TagOf("release", F.concat(F.lit("1.0.0-"), stage))],
        one_row=True,
    )


def customer_items(spark: SparkSession, d: str) -> TagColumns:
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return TagColumns(
        joined,
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")),
        [TagOf("segment", F.col("c_mktsegment")), TagOf("nation", F.col("n_name"), "geo"), number_tag("bal", "c_acctbal", "acct")],
        one_row=True,
    )


def by_tail(a: str, b: str) -> int | None:
    """Compares what follows the last dot, as a number; a text without one isn't comparable."""
    x, y = a.rpartition(".")[2], b.rpartition(".")[2]
    return None if "." not in a or not (x.isdecimal() and y.isdecimal()) else (int(x) > int(y)) - (int(x) < int(y))


def with_settings(store: str, query: str, *settings: tuple[str, str, str]) -> Callable[[SparkSession, str], DataFrame]:
    """A query over a store with added setting tags (namespace, target, value)."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        extra = spark.createDataFrame([("settings", *x) for x in settings], "id string, ns string, key string, value string")
        made = TagStore.from_tags(store_of(store)(spark, d).tags.unionByName(extra))
        made.register_type("version", VERSION)
        made.register_type("semver", SEMVER)
        made.register_type("tail", by_tail)
        return made.query(query)

    return run


def event_writes(spark: SparkSession, d: str, scalar: str | None, since: int) -> DataFrame:
    """Events as a write log by event_id, with a key declared scalar at a given time. Items are
    a user's events among a thousand."""
    item = F.concat_ws("-", F.concat(F.lit("u"), F.col("user_id").cast("string")), F.floor(F.col("event_id") / 1000).cast("string"))
    rows = table(spark, d, "events").select(
        (F.col("event_id") * 2).alias("seq"), F.lit(0).alias("pos"), item.alias("id"),
        F.lit(None).cast("string").alias("ns"), F.lit("event").alias("key"), F.col("event_type").alias("value"),
    )
    if scalar is None:
        return rows
    setting = spark.createDataFrame([(since, 0, "settings", ARITY, scalar, "scalar")], "seq bigint, pos int, id string, ns string, key string, value string")
    return rows.unionByName(setting)


def arity(query: str, scalar: str | None, since: int = -1) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: TagStore.from_writes(event_writes(s, d, scalar, since)).query(query)


def bucketed(query: str, strategy: str = "auto") -> Callable[[SparkSession, str], DataFrame]:
    """A query over the live tags in the bucketed layout."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        path = scratch(spark, "long")
        write_long(table(spark, d, "tags"), path, buckets=16, files_per_bucket=2)
        store = TagStore.from_tags(read_long(spark, path), table(spark, d, "store_items"), root_of(spark, d))
        store.register_type("semver", SEMVER)
        return store.query(query, strategy)

    return run


def text_files(spark: SparkSession, d: str) -> DataFrame:
    """Orders as lines in text files, read back and asked."""
    path = scratch(spark, "lines")
    line_source.to_lines(order_items(spark, d).nested()).write.text(path)
    log = saved(line_source.to_writes(line_source.read_lines(spark, path)))
    return TagStore.from_writes(log).query("urgent and not status=F")


def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Nested items as JSON lines, read back and asked."""
    path = scratch(spark, "json")
    line_source.write_jsonl(table(spark, d, "items_nested"), path)
    return TagStore.from_nested(line_source.read_jsonl(spark, path), root_of(spark, d)).query("lang=en or sys:state=idle")


def nation_lines(spark: SparkSession, d: str) -> list[str]:
    """The nations, a table of fixed size, as lines."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()
    return [f'n{r["n_nationkey"]} name="{r["n_name"]}" geo:region={r["n_regionkey"]}' + (" even" if r["n_nationkey"] % 2 == 0 else "") for r in rows]


def at_hand(spark: SparkSession, d: str) -> DataFrame:
    """Lines at hand, as from standing input."""
    writes, items = line_source.lines_of(spark, ["", *nation_lines(spark, d), " \t "])
    return TagStore.from_writes(writes, items).query("geo:region>=2 and not even")


def grown(spark: SparkSession, d: str) -> DataFrame:
    """A store begun empty, to which items and lines are added one by one."""
    store = TagStore.empty(spark)
    for k, line in enumerate(nation_lines(spark, d)):
        store.add_line(line)
        store.add_item(f"extra{k}", [Tag(None, "and", str(k % 3)), Tag("x", "not", None)])
    store.add_item("bare", [])
    return store.query('"and"=1 or x:not and and=2 or even and geo:region=0')


def written_ids(spark: SparkSession, d: str) -> DataFrame:
    """A result in the id sink, one id a line, read back."""
    path = scratch(spark, "ids")
    line_source.write_ids(store_of("parts")(spark, d).query("size>45"), path)
    return spark.read.text(path).select(F.col("value").alias("id"))


def joined_result(spark: SparkSession, d: str) -> DataFrame:
    ids = TagStore.from_writes(line_source.lines_of(spark, nation_lines(spark, d))[0]).query("geo:region<2")
    return spark.createDataFrame([(line_source.joined_ids(ids),)], "ids string")


#: Query texts, the form they are in, and the postfix they compile to (None: they can't).
TEXTS: list[tuple[str, str, str | None]] = [
    ("a b or c", "infix", "a/b/and/c/or"),
    ("not (a or b) c", "infix", "a/b/or/not/c/and"),
    ("not not a", "infix", "a/not/not"),
    ('"and" or x:or', "infix", '"and"/x:or/or'),
    ("not=1 and or=2", "infix", "not=1/or=2/and"),
    ('k="a b/c" OR j', "infix", 'k="a b/c"/j/or'),
    ("a and", "infix", None),
    ("or a", "infix", None),
    ("a not", "infix", None),
    ("(a", "infix", None),
    ("a)", "infix", None),
    ("()", "infix", None),
    ("", "infix", None),
    ("   ", "infix", None),
    ('k="open', "infix", None),
    ("a and b=*x", "infix", None),
    ("a/b/c", "postfix", "a/b/c"),
    ("a/not", "postfix", "a/not"),
    ("a/and", "postfix", None),
    ("not", "postfix", None),
    ("a/b/or/or", "postfix", None),
    ("", "postfix", None),
    ("a//b", "postfix", None),
    ("nothing-has-this/and/b=*x", "postfix", None),
]


def compiled_texts(spark: SparkSession, d: str) -> DataFrame:
    def compiled(text: str, form: str) -> str | None:
        try:
            return compile_infix(text) if form == "infix" else compile_postfix(text).postfix
        except QueryError:
            return None

    return spark.createDataFrame([(t, f, compiled(t, f)) for t, f, _ in TEXTS], "text string, form string, postfix string")


#: Three items with tags of all kinds, and what queries find there (expected results).
SCENARIO_LINES = [
    "a urgent lang=en lang=fr range=5 geo:lat=57.64 status=done",
    "b range=tbd lang=en prio:urgent due=2026-08-01",
    "c urgent=false score=-3 note",
]
SCENARIOS = {
    "urgent": "a c", "*:urgent": "a b c", "+:urgent": "b", "prio:*": "b", "geo:lat>57": "a", "geo:lat<57": "", "range>=5": "a", "range<tbd": "", "range!=5": "b",
    "lang=en": "a b", "lang!=en": "a", "not lang=en": "c", "not urgent": "b", "score<0": "c", "score<-3": "", "score<=-3": "c", "due~2026-..-..": "b", "due~2026": "",
    "note": "c", "note=+": "", "note=*": "c", "urgent=+": "c", "+:+=+": "a", "+": "a b c", "lang=fr or score<0": "a c", "urgent and not status=done": "c",
    "urgent range=5 status=done": "a", "not (urgent or prio:urgent)": "", "not not urgent": "a c", "*:*=en": "a b", "status=done or not lang": "a c",
}


def scenario_answers(spark: SparkSession) -> DataFrame:
    """``(query, id)`` of every scenario's answer, the plans taking turns."""
    writes, items = line_source.lines_of(spark, SCENARIO_LINES)
    store = TagStore.from_writes(writes, items)
    answers = [store.query(q, ("fused", "nested", "posting")[k % 3]).select(F.lit(q).alias("query"), "id") for k, q in enumerate(SCENARIOS)]
    return reduce(DataFrame.unionByName, answers)


def atom_alone(spark: SparkSession, d: str) -> DataFrame:
    """An atom on its own, without any settings, against every item's tags."""
    atom = parse_atom("*:version~2....")
    return table(spark, d, "items_nested").filter(atom_matches(atom, F.col("tags"))).select("id")


def shown_by(*patterns: str) -> Callable[[SparkSession, str], DataFrame]:
    """The tags that a visibility made of these patterns shows."""
    made = HideConfig.from_patterns(patterns)
    return lambda s, d: table(s, d, "tags").filter(~hidden(made.patterns, F.col("ns"), F.col("key"))).select("id", "ns", "key", "value").distinct()


def line_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Orders spelled as lines, read back, and asked."""
    text = line_source.to_lines(order_items(spark, d).nested()).withColumn("seq", F.monotonically_increasing_id())
    log = saved(line_source.to_writes(line_source.parse_lines(text)))  # settings and tags are read from it
    return TagStore.from_writes(log).query('priority="4-NOT SPECIFIED" and not status=F')


def ingest(spark: SparkSession, d: str) -> DataFrame:
    """The valid raw lines, by built-in expressions."""
    parsed = line_source.parse_lines(table(spark, d, "tag_lines"), "dropmalformed")
    return line_source.to_writes(parsed).distinct()


def store_of(name: str) -> Callable[[SparkSession, str], TagStore]:
    tables = {
        "orders": [order_items], "documents": [document_items], "parts": [part_items], "customers": [customer_items],
        "lines": [lineitem_tags], "events": [event_tags], "shop": [order_items, lineitem_tags],
    }

    def make(spark: SparkSession, d: str) -> TagStore:
        if name in tables:
            return TagStore.from_columns(*[t(spark, d) for t in tables[name]])
        root = root_of(spark, d)
        if name == "nested":
            store = TagStore.from_nested(table(spark, d, "items_nested"), root)
        elif name in ("writes", "settled"):
            store = TagStore.from_writes(table(spark, d, "writes"), table(spark, d, "store_items"), root)
            store = store.settled() if name == "settled" else store
        else:
            store = TagStore.from_tags(table(spark, d, "tags"), table(spark, d, "store_items"), root)
        store.register_type("semver", SEMVER)
        return store

    return make


def ask(store: str, query: str, strategy: str = "auto", postfix: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = store_of(store)(spark, d)
        return (s.query_postfix if postfix else s.query)(query.replace("{R}", s.root), strategy)

    return run


# The views of the stores in SQL, as (id, ns, key, value).
_VIEW = {
    "orders": """
      SELECT 'o' || o_orderkey AS id, NULL AS ns, 'status' AS key, o_orderstatus AS value FROM orders UNION ALL
      SELECT 'o' || o_orderkey, NULL, 'priority', o_orderpriority FROM orders UNION ALL
      SELECT 'o' || o_orderkey, 'order', 'total', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) FROM orders UNION ALL
      SELECT 'o' || o_orderkey, NULL, 'due', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL
      SELECT 'o' || o_orderkey, NULL, 'urgent', NULL FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "lines": """
      SELECT 'o' || l_orderkey AS id, NULL AS ns, 'flag' AS key, l_returnflag AS value FROM lineitem UNION ALL
      SELECT 'o' || l_orderkey, 'line', 'status', l_linestatus FROM lineitem UNION ALL
      SELECT 'o' || l_orderkey, 'line', 'qty', CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) FROM lineitem UNION ALL
      SELECT 'o' || l_orderkey, NULL, 'ship', strftime(l_shipdate, '%Y-%m-%d') FROM lineitem""",
    "events": """
      SELECT 'u' || user_id AS id, NULL AS ns, 'event' AS key, event_type AS value FROM events UNION ALL
      SELECT 'u' || user_id, 'ev', 'value', CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) FROM events UNION ALL
      SELECT 'u' || user_id, NULL, 'errored', NULL FROM events WHERE event_type = 'error'""",
    "documents": """
      SELECT 'd' || doc_id AS id, NULL AS ns, 'lang' AS key, lang AS value FROM documents WHERE lang IS NOT NULL UNION ALL
      SELECT 'd' || doc_id, NULL, 'source', source FROM documents WHERE source IS NOT NULL UNION ALL
      SELECT 'd' || doc_id, 'meta', 'chars', CAST(n_chars AS VARCHAR) FROM documents WHERE n_chars IS NOT NULL""",
    "parts": """
      SELECT 'p' || p_partkey AS id, NULL AS ns, 'brand' AS key, p_brand AS value FROM part UNION ALL
      SELECT 'p' || p_partkey, NULL, 'size', CAST(p_size AS VARCHAR) FROM part UNION ALL
      SELECT 'p' || p_partkey, NULL, 'ver', p_size || '.' || p_partkey % 20 FROM part UNION ALL
      SELECT 'p' || p_partkey, NULL, 'release', '1.0.0-' || CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey % 12 AS VARCHAR)
        WHEN 1 THEN 'beta' WHEN 2 THEN 'beta.' || p_partkey % 12 ELSE 'alpha-1' END FROM part""",
    "customers": """
      SELECT 'c' || c_custkey AS id, NULL AS ns, 'segment' AS key, c_mktsegment AS value FROM customer UNION ALL
      SELECT 'c' || c_custkey, 'geo', 'nation', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL
      SELECT 'c' || c_custkey, 'acct', 'bal', CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) FROM customer""",
    "tags": "SELECT id, ns, key, value FROM tags",
}
_VIEW["shop"] = _VIEW["orders"] + " UNION ALL " + _VIEW["lines"]
_NUM = "CASE WHEN regexp_full_match(value, '[-+]?[0-9]+([.][0-9]+)?') THEN TRY_CAST(value AS DOUBLE) END"
# What the settings in `tags` hide, besides the root namespace.
_R = "(SELECT regexp_extract(min(ns), '^(.+)[.](hide|arity)$', 1) FROM tags WHERE ns LIKE '%.hide' AND value IN ('true', 'false') OR ns LIKE '%.arity' AND value IN ('scalar', 'set'))"
_ROOT = f"(coalesce(ns = {_R}, false) OR coalesce(starts_with(ns, {_R} || '.'), false))"
_X9 = "(coalesce(ns = 'x9', false) OR coalesce(starts_with(ns, 'x9.'), false))"
_DIGEST = "(coalesce(ns = 'src', false) AND key = 'digest')"
_SEEN = f"NOT {_ROOT} AND NOT {_X9} AND NOT {_DIGEST}"
_CORE = "list_transform(string_split(string_split(string_split(value, '+')[1], '-')[1], '.'), lambda x: TRY_CAST(x AS UBIGINT))"
_PRE = "contains(string_split(value, '+')[1], '-')"


def _any(condition: str) -> str:
    return f"coalesce(bool_or({condition}), false)"


def _ids(view: str, having: str) -> str:
    return f"WITH v AS ({_VIEW[view]}) SELECT id FROM v GROUP BY id HAVING {having}"


def _has(key: str, value: str | None = None, ns: str | None = None) -> str:
    place = "ns IS NULL" if ns is None else f"ns = '{ns}'"
    return _any(f"{place} AND key = '{key}'" + ("" if value is None else f" AND value = '{value}'"))


def _quote(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


_URGENT, _STATUS_F = _has("urgent"), _has("status", "F")
_DEBT = _any(f"ns = 'acct' AND key = 'bal' AND {_NUM} < 0")
_DUE_1997 = "ns IS NULL AND key = 'due' AND value LIKE '1997-__-__'"

# name: (store, query, the condition on an item's tags in SQL[, strategy or "postfix"])
_ASKED: dict[str, tuple[str, ...]] = {
    # One atom: namespace, key and value positions.
    "bare_key": ("orders", "urgent", _any("ns IS NULL AND key = 'urgent'")),
    "ns_exact": ("orders", "order:total", _any("ns = 'order' AND key = 'total'")),
    "ns_any": ("shop", "*:status", _any("key = 'status'")),
    "ns_named": ("shop", "+:status", _any("ns IS NOT NULL AND key = 'status'")),
    "key_wild": ("shop", "line:*", _any("ns = 'line'")),
    "key_wild_plus": ("shop", "line:+", _any("ns = 'line'")),
    "bare_star": ("customers", "*", _any("ns IS NULL")),
    "universe": ("tags", "*:*", _any(_SEEN)),
    "val_any": ("orders", "urgent=*", _any("ns IS NULL AND key = 'urgent'")),
    "val_present": ("tags", "+:+=+", _any(f"ns IS NOT NULL AND value IS NOT NULL AND {_SEEN}")),
    "val_present_none": ("orders", "urgent=+ or status=P", _any("ns IS NULL AND (key = 'urgent' AND value IS NOT NULL OR key = 'status' AND value = 'P')")),
    "val_any_gt": ("orders", "urgent>*", _any("ns IS NULL AND key = 'urgent'")),
    "val_empty": ("tags", '*:*=""', _any(f"value = '' AND {_SEEN}")),
    "eq": ("lines", "flag=R", _any("ns IS NULL AND key = 'flag' AND value = 'R'")),
    "ne_existential": ("lines", "flag!=R", _any("ns IS NULL AND key = 'flag' AND value <> 'R'")),
    "num_gt": ("orders", "*:total>100000", _any(f"key = 'total' AND {_NUM} > 100000")),
    "num_ge": ("parts", "size>=25", _any(f"key = 'size' AND {_NUM} >= 25")),
    "num_lt": ("parts", "size<5", _any(f"key = 'size' AND {_NUM} < 5")),
    "num_le": ("lines", "line:qty<=3", _any(f"ns = 'line' AND key = 'qty' AND {_NUM} <= 3")),
    "num_negative": ("customers", "acct:bal<0", _any(f"ns = 'acct' AND key = 'bal' AND {_NUM} < 0")),
    "num_dirty": ("tags", "rank>100", _any(f"ns IS NULL AND key = 'rank' AND {_NUM} > 100")),
    "num_quoted": ("tags", '"":rank>"100"', _any(f"ns = '' AND key = 'rank' AND {_NUM} > 100")),
    "num_uninterpretable": ("orders", "priority>1 or status=P", _has("status", "P")),
    "anchored": ("orders", "due~1997-..-..", _any(_DUE_1997)),
    "anchored_len": ("orders", "due~1997 or status=P", f"{_any('''ns IS NULL AND key = 'due' AND value LIKE '1997' ''')} OR {_has('status', 'P')}"),
    "anchored_literal": ("customers", '*:*~"......_.."', _any("value LIKE '______~___' ESCAPE '~'")),
    "quoted_value": ("orders", 'priority="4-NOT SPECIFIED"', _any("ns IS NULL AND key = 'priority' AND value = '4-NOT SPECIFIED'")),
    "quoted_hash": ("parts", 'brand="Brand#13"', _any("ns IS NULL AND key = 'brand' AND value = 'Brand#13'")),
    # Boolean algebra.
    "and": ("orders", "urgent and status=F", f"{_URGENT} AND {_STATUS_F}"),
    "or": ("customers", "segment=BUILDING or acct:bal<0", f"{_has('segment', 'BUILDING')} OR {_DEBT}"),
    "not": ("orders", "not urgent", f"NOT {_URGENT}"),
    "and_not": ("orders", "status=F and not urgent", f"{_STATUS_F} AND NOT {_URGENT}"),
    "not_not": ("orders", "not not urgent", _URGENT),
    "demorgan": ("orders", "not (status=F or not urgent)", f"NOT ({_STATUS_F} OR NOT {_URGENT})"),
    "demorgan_and": ("lines", "not (flag=R and not line:status=F)", f"NOT ({_has('flag', 'R')} AND NOT {_has('status', 'F', 'line')})"),
    "or_not": ("lines", "flag=R or not flag=N", f"{_has('flag', 'R')} OR NOT {_has('flag', 'N')}"),
    "no_value_v": ("lines", "flag and not flag=R", f"{_has('flag')} AND NOT {_has('flag', 'R')}"),
    "precedence": ("orders", "urgent or status=F and not priority=5-LOW", f"{_URGENT} OR {_STATUS_F} AND NOT {_has('priority', '5-LOW')}"),
    "parentheses": ("orders", "(urgent or status=F) and due~1997-..-..", f"({_URGENT} OR {_STATUS_F}) AND {_any(_DUE_1997)}"),
    "juxtapose": ("orders", "urgent status=F", f"{_URGENT} AND {_STATUS_F}"),
    "case_ops": ("orders", "urgent AND Not status=F", f"{_URGENT} AND NOT {_STATUS_F}"),
    "postfix_query": ("orders", "urgent/status=F/not/and", f"{_URGENT} AND NOT {_STATUS_F}", "postfix"),
    "postfix_fold": ("orders", "urgent/status=F", f"{_URGENT} AND {_STATUS_F}", "postfix"),
    "double_wild_eq": ("shop", "*:*=F", _any("value = 'F'")),
    "double_wild_ne": ("shop", "+:*!=F", _any("ns IS NOT NULL AND value <> 'F'")),
    "double_wild_gt": ("shop", "*:*>49", _any(f"{_NUM} > 49")),
    "double_wild_match": ("shop", "*:*~F", _any("value LIKE 'F'")),
    "multi_valued": ("lines", "flag=R and flag=N and not line:status=X", f"{_has('flag', 'R')} AND {_has('flag', 'N')}"),
    "documents_tags": ("documents", "lang=en and meta:chars>3000 and not source=ocr", f"{_has('lang', 'en')} AND {_any(f'''ns = 'meta' AND key = 'chars' AND {_NUM} > 3000''')} AND NOT {_has('source', 'ocr')}"),
    "gate_8atom": (
        "shop", "(status=F or status=P) and not urgent and *:total>50000 and due~199.-..-.. and (line:qty>=45 or flag=R) and not line:status=X",
        f"({_STATUS_F} OR {_has('status', 'P')}) AND NOT {_URGENT} AND {_any(f'''key = 'total' AND {_NUM} > 50000''')} AND {_any('''ns IS NULL AND key = 'due' AND value LIKE '199_-__-__' ''')}"
        f" AND ({_any(f'''ns = 'line' AND key = 'qty' AND {_NUM} >= 45''')} OR {_has('flag', 'R')}) AND NOT {_has('status', 'X', 'line')}",
    ),
    # The same questions by the other plans.
    "posting_and_not": ("shop", "flag=R and not urgent", f"{_has('flag', 'R')} AND NOT {_URGENT}", "posting"),
    "posting_demorgan": ("shop", "not (flag=R or urgent)", f"NOT ({_has('flag', 'R')} OR {_URGENT})", "posting"),
    "posting_or_not": ("shop", "status=P or not flag=N", f"{_has('status', 'P')} OR NOT {_has('flag', 'N')}", "posting"),
    "fused_complement": ("orders", "not (urgent and status=F)", f"NOT ({_URGENT} AND {_STATUS_F})", "fused"),
    "nested_tags": ("nested", "lang=en and not sys:state=idle", f"{_has('lang', 'en')} AND NOT {_has('state', 'idle', 'sys')} AND {_any(_SEEN)}", "nested"),
    # Visibility. The store's own settings hide x9 with all keys, and src:digest.
    "hide_default_off": ("tags", "{R}.hide:*", _any(f"ns = {_R} || '.hide'")),
    "hide_ns_wild_finds_none": ("tags", "*:* and not (+:* or *) or topic", _has("topic")),
    "hide_ns_named": ("tags", "x9:*", _any("ns = 'x9'")),
    "hide_key_named": ("tags", "src:digest", _any("ns = 'src' AND key = 'digest'")),
    "hide_key_wild": ("tags", "*:digest or lang=fr", f"{_any(f'''key = 'digest' AND {_SEEN}''')} OR {_has('lang', 'fr')}"),
    "hide_key_under_ns": ("tags", "src:*", _any("ns = 'src'")),
    "hide_other_key": ("tags", "src:path and not *:digest", f"{_has('path', ns='src')} AND NOT {_any(f'''key = 'digest' AND {_SEEN}''')}"),
    "hide_complement": ("tags", "not topic", f"NOT {_has('topic')} AND {_any(_SEEN)}"),
    "hide_complement_revealed": ("tags", "not x9:none", f"NOT {_has('none', ns='x9')} AND {_any(f'''NOT {_ROOT} AND NOT {_DIGEST}''')}"),
    "hide_ignored_value": ("tags", "*:ref", _has("ref", ns="link")),
    # Typed comparison: the store declares rel:version as a semantic version.
    "type_semver_gt": ("tags", "rel:version>2.5.0", _any(f"ns = 'rel' AND key = 'version' AND {_CORE} > [2, 5, 0]")),
    "type_semver_ge": ("tags", "rel:version>=2.5.0", _any(f"ns = 'rel' AND key = 'version' AND ({_CORE} > [2, 5, 0] OR {_CORE} = [2, 5, 0] AND NOT {_PRE})")),
    "type_semver_lt": ("tags", "rel:version<1.0.0+b", _any(f"ns = 'rel' AND key = 'version' AND ({_CORE} < [1, 0, 0] OR {_CORE} = [1, 0, 0] AND {_PRE})")),
    "type_semver_wild": ("tags", "*:version>=4.0.0", _any(f"ns = 'rel' AND key = 'version' AND ({_CORE} > [4, 0, 0] OR {_CORE} = [4, 0, 0] AND NOT {_PRE})")),
}


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flagship": ask("orders", "status=F and not priority=5-LOW"),
    **{n: ask(a[0], a[1], "auto" if a[3:] in ((), ("postfix",)) else a[3], a[3:] == ("postfix",)) for n, a in _ASKED.items()},
    "matching_ids": lambda s, d: store_of("parts")(s, d).matching_ids("size>=40"),
    "all_ids": lambda s, d: store_of("tags")(s, d).all_ids(),
    "participating": lambda s, d: store_of("tags")(s, d).participating(),
    "hide_display": lambda s, d: store_of("tags")(s, d).displayed(),
    "hide_ns": with_settings("shop", "*:* and not urgent", (HIDE, "line:*", "true")),
    "hide_key": with_settings("customers", "*:bal<0 or segment=BUILDING", (HIDE, "acct:bal", "true")),
    "hide_key_revealed": with_settings("customers", "acct:bal<0", (HIDE, "acct:bal", "true")),
    "hide_cross_ns": with_settings("shop", "*:status=F or urgent", (HIDE, "*:status", "true")),
    "hide_cross_ns_revealed": with_settings("shop", "line:status=F", (HIDE, "*:status", "true")),
    "hide_null_ns": with_settings("orders", "urgent or *:urgent", (HIDE, "urgent", "true")),
    "hide_both": with_settings("customers", "acct:none or *:bal>0 or *:nation=NATION_7", (HIDE, "acct:*", "true"), (HIDE, "acct:bal", "true")),
    "hide_off": with_settings("customers", "*:*", (HIDE, f"{ROOT_NS}:*", "false")),
    "type_version": with_settings("parts", "ver>24.9", (TYPE, "ver", "version")),
    "type_version_le": with_settings("parts", "ver<=3.10", (TYPE, "ver", "version")),
    "type_conflict": with_settings("parts", "ver>24.9", (TYPE, "ver", "version"), (TYPE, "ver", "date")),
    "type_unregistered": with_settings("parts", "ver>24.9", (TYPE, "ver", "unheard")),
    "type_undeclared": with_settings("parts", "size>40", (TYPE, "ver", "version")),
    "type_prerelease_number": with_settings("parts", "release>1.0.0-8", (TYPE, "release", "semver")),
    "type_prerelease_name": with_settings("parts", "release<1.0.0-beta.10", (TYPE, "release", "semver")),
    "type_prerelease_length": with_settings("parts", "release>1.0.0-beta", (TYPE, "release", "semver")),
    "type_python": with_settings("parts", "ver>0.9", (TYPE, "ver", "tail")),
    "type_python_le": with_settings("parts", "ver<=0.4 and not ver<=0.2", (TYPE, "ver", "tail")),
    "arity_set": arity("event=click", None),
    "arity_scalar": arity("event=click", "event"),
    "arity_late": arity("event=click and event=view", "event", 9_001),
    "arity_sibling": arity("event=click", "other"),
    "collapse": lambda s, d: live_tags(table(s, d, "writes"), root_of(s, d)),
    "writes_query": ask("writes", "sys:state=idle and not owner"),
    "writes_or": ask("writes", "sys:state=idle or owner or *:rank>500"),
    "writes_complement": ask("writes", "not (topic or sys:state=idle)"),
    "settled_query": ask("settled", "sys:state=idle and not owner"),
    "bucketed_key": bucketed("owner"),
    "bucketed_point": bucketed("sys:state=idle"),
    "bucketed_range": bucketed("rank>300"),
    "bucketed_typed": bucketed("rel:version>=2.5.0"),
    "bucketed_and_not": bucketed("lang=en and not sys:state=idle"),
    "bucketed_or": bucketed("owner or sys:state=idle and rank<100"),
    "bucketed_complement": bucketed("not (owner or sys:state=idle)"),
    "bucketed_posting": bucketed("lang=en and not sys:state=idle", "posting"),
    "bucketed_wild": bucketed("*:rank>300 and lang"),
    "text_files": text_files,
    "json_lines": json_lines,
    "lines_at_hand": at_hand,
    "grown_store": grown,
    "id_sink": written_ids,
    "joined_result": joined_result,
    "compiled_texts": compiled_texts,
    "atom_alone": atom_alone,
    "hide_patterns": shown_by("x9:*", "*:rank", "lang"),
    "hide_no_patterns": shown_by(),
    "found_by_scenarios": lambda s, d: scenario_answers(s),
    "to_nested": lambda s, d: to_nested(table(s, d, "tags"), table(s, d, "store_items")).select("id", F.size("tags").alias("n_tags")),
    "to_long": lambda s, d: to_long(table(s, d, "items_nested")),
    "line_round_trip": line_round_trip,
    "line_ingest": ingest,
    "p1_found": lambda s, d: hot_keys.hot_keys(table(s, d, "writes")),
    "p1_profile": lambda s, d: hot_keys.key_profile(table(s, d, "writes")),
    "p4_found": lambda s, d: wide.failed_cells(*(table(s, d, t) for t in ("tags", "store_items", "attr_catalog"))),
    "p5_found": lambda s, d: reject.rejected(table(s, d, "tag_lines"), table(s, d, "tag_export")),
    "p5_loaded": lambda s, d: reject.loaded_tags(table(s, d, "tag_lines"), table(s, d, "tag_export")),
    "p4_failed": lambda s, d: wide.widen(*(table(s, d, t) for t in ("tags", "store_items", "attr_catalog"))).select(
        "id", F.explode("failed").alias("col_name", "why")).select("id", "col_name", "why.reason", "why.n_rows", "why.n_unread"),
    "p4_wide": lambda s, d: wide.widen(*(table(s, d, t) for t in ("tags", "store_items", "attr_catalog"))).drop("failed"),
}

_GRAINS = """
named AS (
  SELECT 'ns' AS grain, coalesce(ns, '-') AS name, id, value FROM writes UNION ALL
  SELECT 'key', key, id, value FROM writes UNION ALL
  SELECT 'attr', CASE WHEN ns IS NULL THEN key ELSE ns || ':' || key END, id, value FROM writes)
"""

_STAMP = "([0-9]{4}-[0-9]{2}-[0-9]{2})T((?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9])(Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])"
_READ = f"""
cell AS (
  SELECT t.id, a.col_name, a.many, CASE a.col_type
    WHEN 'string' THEN t.value
    WHEN 'bigint' THEN CASE WHEN regexp_full_match(t.value, '[+-]?[0-9]+') THEN CAST(TRY_CAST(t.value AS BIGINT) AS VARCHAR) END
    WHEN 'double' THEN CASE WHEN regexp_full_match(t.value, '[+-]?[0-9]+([.][0-9]+)?') THEN CAST(TRY_CAST(t.value AS DOUBLE) + 0.0 AS VARCHAR) END
    WHEN 'boolean' THEN CASE WHEN lower(t.value) IN ('true', 'false') THEN lower(t.value) END
    WHEN 'date' THEN CASE WHEN regexp_full_match(t.value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN CAST(TRY_CAST(t.value AS DATE) AS VARCHAR) END
    WHEN 'timestamp' THEN CASE WHEN regexp_full_match(t.value, '{_STAMP}') THEN CAST(
      TRY_CAST(replace(t.value[1:19], 'T', ' ') AS TIMESTAMP)
      - CASE WHEN t.value[20:20] = 'Z' THEN INTERVAL 0 SECOND
        ELSE (CASE WHEN t.value[20:20] = '-' THEN -1 ELSE 1 END * (CAST(t.value[21:22] AS INT) * 60 + CAST(t.value[24:25] AS INT))) * INTERVAL 1 MINUTE END AS VARCHAR) END
    END AS text
  FROM tags t JOIN attr_catalog a ON t.key = a.key AND t.ns IS NOT DISTINCT FROM a.ns
  WHERE t.id IN (SELECT id FROM store_items))
"""

# The catalogue's columns and types (fixed values); the SQL needs them spelled out.
_WIDE = {
    "rank_no": "bigint", "lat": "double", "lon": "double", "due_on": "date", "owner_name": "varchar", "state": "varchar",
    "priority_no": "bigint", "budget": "double", "reviewed": "boolean", "seen_at": "timestamp", "version_text": "varchar",
    "serial": "varchar", "digest": "varchar", "title": "varchar", "path": "varchar", "site": "varchar", "blank_rank": "bigint",
    "closed_on": "date", "retries": "bigint", "score": "double",
}
_WIDE_MANY = ("topics", "langs", "refs", "notes", "hops")


def _wide_sql() -> str:
    one = ", ".join(
        f"CASE WHEN count(DISTINCT text) FILTER (col_name = '{c}') = 1 THEN CAST(min(text) FILTER (col_name = '{c}') AS {t}) END AS {c}"
        for c, t in _WIDE.items()
    )
    many = ", ".join(f"list_sort(list(DISTINCT text) FILTER (col_name = '{c}' AND text IS NOT NULL)) AS {c}" for c in _WIDE_MANY)
    return f"WITH {_READ} SELECT i.id, {one}, {many} FROM (SELECT DISTINCT id FROM store_items) i LEFT JOIN cell USING (id) GROUP BY i.id"


_ONLY = "SELECT id FROM v GROUP BY id HAVING"
_EVENT_ITEM = "'u' || user_id || '-' || event_id // 1000"
_EVENT_LAST = f"""WITH ranked AS (
  SELECT {_EVENT_ITEM} AS id, event_type, row_number() OVER (PARTITION BY user_id, event_id // 1000 ORDER BY event_id DESC) AS k FROM events)"""
_LIVE = f"""WITH t AS (
  SELECT CASE WHEN contains(key, ':') THEN split_part(key, ':', 1) END AS ns,
         CASE WHEN contains(key, ':') THEN substr(key, instr(key, ':') + 1) ELSE key END AS key, min(seq) AS since
  FROM writes WHERE ns = {_R} || '.arity' AND value = 'scalar' GROUP BY 1, 2),
w AS (
  SELECT w.*, coalesce(w.seq > t.since, false) AS governed
  FROM writes w LEFT JOIN t ON w.key = t.key AND w.ns IS NOT DISTINCT FROM t.ns),
r AS (
  SELECT *, row_number() OVER (PARTITION BY id, ns, key, governed ORDER BY seq DESC, pos DESC) AS k,
         bool_or(governed) OVER (PARTITION BY id, ns, key) AS ruled FROM w),
v AS (SELECT DISTINCT id, ns, key, value FROM r WHERE CASE WHEN ruled THEN governed AND k = 1 ELSE true END)
"""
_STAGE = "TRY_CAST(regexp_extract(value, '([0-9]+)$', 1) AS INT)"
_NUMBERED = "regexp_full_match(value, '1[.]0[.]0-[0-9]+')"
_TAIL = "TRY_CAST(split_part(value, '.', 2) AS INT)"
_VERSION = "list_transform(string_split(value, '.'), lambda x: TRY_CAST(x AS BIGINT))"

# Raw lines and records in SQL. DuckDB's patterns know no lookahead, so the lone + is
# left out by spelling two kinds of bare token.
_WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_Q = '"[^"]*(?:""[^"]*)*"'
_TOKEN = f"(?:{_Q}|[A-Za-z0-9_-][A-Za-z0-9_.+-]*|[+][A-Za-z0-9_.+-]+)"
_TAG = f"(?:({_TOKEN}):)?({_TOKEN})(?:=({_TOKEN}))?"
_UNMIXED = f'(?:{_Q}|[^":=]*)(?::(?:{_Q}|[^":=]*))*(?:=(?:{_Q}|[^"=]*))*'
_CELL = f'(?:{_Q}|[^",]+|)'


def _count(text: str, sign: str) -> str:
    return f"(length({text}) - length(replace({text}, '{sign}', '')))"


def _decoded(raw: str) -> str:
    return f"CASE WHEN {raw} = '' THEN NULL WHEN {raw}[1:1] = '\"' THEN replace({raw}[2:length({raw}) - 1], '\"\"', '\"') ELSE {raw} END"


_PARSED = f"""
line AS (
  SELECT DISTINCT seq, {_count('value', '"')} % 2 = 1 AS open, regexp_extract_all(value, '(?:{_Q}|[^"{_WS}]+)+') AS f
  FROM tag_lines WHERE regexp_matches(value, '[^{_WS}]')),
tag AS (SELECT seq, f[1] AS id, k - 2 AS pos, f[k] AS t, regexp_replace(f[k], '{_Q}', 'x', 'g') AS b FROM line, unnest(range(2, len(f) + 1)) AS u(k)),
graded AS (
  SELECT *, CASE WHEN NOT regexp_full_match(t, '{_UNMIXED}') THEN 1
    WHEN {_count('b', '=')} > 1 OR {_count("split_part(b, '=', 1)", ':')} > 1 THEN 2
    WHEN NOT regexp_full_match(t, '{_TAG}') THEN 3 ELSE 4 END AS grade
  FROM tag),
judged AS (
  SELECT line.seq, CASE WHEN line.open THEN 1 ELSE coalesce(min(grade), 4) END AS grade
  FROM line LEFT JOIN graded USING (seq) GROUP BY line.seq, line.open),
record AS (
  SELECT DISTINCT row_no, coalesce(raw, '') AS raw, regexp_replace(coalesce(raw, ''), '{_Q}', 'x', 'g') AS b FROM tag_export),
cut AS (
  SELECT row_no, NOT regexp_full_match(raw, '{_CELL}(?:,{_CELL})*') AS broken, {_count('b', ',')} AS commas,
         {', '.join(f"regexp_extract(raw, '^{f'({_CELL}),' * 5}({_CELL})$', {k})" + f" AS r{k}" for k in range(1, 7))}
  FROM record),
cells AS (SELECT row_no, broken, commas, {', '.join(f"{_decoded(f'r{k}')} AS c{k}" for k in range(1, 7))} FROM cut),
weighed AS (
  SELECT *, CASE WHEN broken THEN 1 WHEN commas <> 5 THEN 2
    WHEN NOT coalesce(regexp_full_match(c1, '[0-9]*[1-9][0-9]*'), false) OR NOT coalesce(regexp_full_match(c2, '[0-9]+'), false)
      OR coalesce(c3, '') = '' OR NOT coalesce(regexp_matches(c5, '[^{_WS}]'), false)
      OR c4 <> '' AND NOT regexp_matches(c4, '[^{_WS}]')
      OR contains(concat_ws(' ', c1, c2, c3, c4, c5, c6), chr(65533)) THEN 3 ELSE 4 END AS grade
  FROM cells)
"""
_LOADED = f"""
SELECT g.seq AS row_no, pos, id, {_decoded(f"regexp_extract(t, '^{_TAG}$', 1)")} AS ns,
       {_decoded(f"regexp_extract(t, '^{_TAG}$', 2)")} AS key, {_decoded(f"regexp_extract(t, '^{_TAG}$', 3)")} AS value
FROM graded g JOIN judged j ON g.seq = j.seq AND j.grade = 4"""

SQL: dict[str, str] = {
    "line_ingest": f"WITH {_PARSED} SELECT row_no AS seq, pos, id, ns, key, value FROM ({_LOADED})",
    "p5_found": f"""WITH {_PARSED}
SELECT 'lines' AS src, seq AS row_no, ['quoting', 'columns', 'value'][grade] AS reason FROM judged WHERE grade < 4
UNION ALL
SELECT 'export', row_no, ['quoting', 'columns', 'value'][grade] FROM weighed WHERE grade < 4""",
    "p5_loaded": f"""WITH {_PARSED}
SELECT 'lines' AS src, * FROM ({_LOADED})
UNION ALL
SELECT 'export', row_no, CAST(c2 AS BIGINT), c3, c4, c5, c6 FROM weighed WHERE grade = 4""",
    "flagship": _ids("orders", f"{_STATUS_F} AND NOT {_has('priority', '5-LOW')}"),
    **{n: _ids("tags" if a[0] == "nested" else a[0], a[2]) for n, a in _ASKED.items()},
    "matching_ids": _ids("parts", _any(f"key = 'size' AND {_NUM} >= 40")),
    "all_ids": "SELECT id FROM tags UNION SELECT id FROM store_items",
    "participating": _ids("tags", _any(_SEEN)),
    "hide_display": f"SELECT DISTINCT id, ns, key, value FROM tags WHERE {_SEEN}",
    "hide_ns": _ids("shop", f"{_any("ns IS DISTINCT FROM 'line'")} AND NOT {_URGENT}"),
    "hide_key": _ids("customers", _has("segment", "BUILDING")),
    "hide_key_revealed": _ids("customers", _DEBT),
    "hide_cross_ns": _ids("shop", _URGENT),
    "hide_cross_ns_revealed": _ids("shop", _has("status", "F", "line")),
    "hide_null_ns": _ids("orders", _URGENT),
    "hide_both": _ids("customers", _any("key = 'nation' AND value = 'NATION_7'")),
    "hide_off": f"WITH v AS ({_VIEW['customers']}) SELECT id FROM v UNION SELECT 'settings'",
    "type_version": _ids("parts", _any(f"key = 'ver' AND {_VERSION} > [24, 9]")),
    "type_version_le": _ids("parts", _any(f"key = 'ver' AND {_VERSION} <= [3, 10]")),
    "type_conflict": _ids("parts", _any(f"key = 'ver' AND {_NUM} > 24.9")),
    "type_unregistered": _ids("parts", _any(f"key = 'ver' AND {_NUM} > 24.9")),
    "type_undeclared": _ids("parts", _any(f"key = 'size' AND {_NUM} > 40")),
    "type_prerelease_number": _ids("parts", _any(f"key = 'release' AND (NOT {_NUMBERED} OR {_STAGE} > 8)")),
    "type_prerelease_name": _ids("parts", _any(f"key = 'release' AND (value NOT LIKE '%-beta._%' OR {_STAGE} < 10)")),
    "type_prerelease_length": _ids("parts", _any("key = 'release' AND value LIKE '%-beta._%'")),
    "type_python": _ids("parts", _any(f"key = 'ver' AND {_TAIL} > 9")),
    "type_python_le": _ids("parts", _any(f"key = 'ver' AND {_TAIL} <= 4") + " AND NOT " + _any(f"key = 'ver' AND {_TAIL} <= 2")),
    "arity_set": f"SELECT DISTINCT {_EVENT_ITEM} AS id FROM events WHERE event_type = 'click'",
    "arity_scalar": f"{_EVENT_LAST} SELECT id FROM ranked WHERE k = 1 AND event_type = 'click'",
    "arity_late": f"""SELECT {_EVENT_ITEM} AS id FROM events GROUP BY user_id, event_id // 1000
HAVING max(event_id * 2) <= 9001 AND bool_or(event_type = 'click') AND bool_or(event_type = 'view')""",
    "arity_sibling": f"SELECT DISTINCT {_EVENT_ITEM} AS id FROM events WHERE event_type = 'click'",
    "collapse": f"{_LIVE} SELECT id, ns, key, value FROM v",
    "writes_query": f"{_LIVE} {_ONLY} {_has('state', 'idle', 'sys')} AND NOT {_has('owner')}",
    "writes_or": f"{_LIVE} {_ONLY} {_has('state', 'idle', 'sys')} OR {_has('owner')} OR {_any(f'''key = 'rank' AND {_NUM} > 500 AND {_SEEN}''')}",
    "writes_complement": f"{_LIVE} {_ONLY} NOT ({_has('topic')} OR {_has('state', 'idle', 'sys')}) AND {_any(_SEEN)}",
    "settled_query": f"{_LIVE} {_ONLY} {_has('state', 'idle', 'sys')} AND NOT {_has('owner')}",
    "bucketed_key": _ids("tags", _has("owner")),
    "bucketed_point": _ids("tags", _has("state", "idle", "sys")),
    "bucketed_range": _ids("tags", _any(f"ns IS NULL AND key = 'rank' AND {_NUM} > 300")),
    "bucketed_typed": _ids("tags", _ASKED["type_semver_ge"][2]),
    "bucketed_and_not": _ids("tags", f"{_has('lang', 'en')} AND NOT {_has('state', 'idle', 'sys')}"),
    "bucketed_or": _ids("tags", f"{_has('owner')} OR {_has('state', 'idle', 'sys')} AND {_any(f'''ns IS NULL AND key = 'rank' AND {_NUM} < 100''')}"),
    "bucketed_complement": _ids("tags", f"NOT ({_has('owner')} OR {_has('state', 'idle', 'sys')}) AND {_any(_SEEN)}"),
    "bucketed_posting": _ids("tags", f"{_has('lang', 'en')} AND NOT {_has('state', 'idle', 'sys')}"),
    "bucketed_wild": _ids("tags", f"{_any(f'''key = 'rank' AND {_NUM} > 300 AND {_SEEN}''')} AND {_has('lang')}"),
    "text_files": _ids("orders", f"{_URGENT} AND NOT {_STATUS_F}"),
    "json_lines": _ids("tags", f"{_has('lang', 'en')} OR {_has('state', 'idle', 'sys')}"),
    "lines_at_hand": "SELECT 'n' || n_nationkey AS id FROM nation WHERE n_regionkey >= 2 AND n_nationkey % 2 = 1",
    "grown_store": """SELECT 'extra' || n_nationkey AS id FROM nation WHERE n_nationkey % 3 IN (1, 2)
UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey = 0""",
    "id_sink": _ids("parts", _any(f"key = 'size' AND {_NUM} > 45")),
    "joined_result": "SELECT string_agg('n' || n_nationkey, chr(10) ORDER BY 'n' || n_nationkey) AS ids FROM nation WHERE n_regionkey < 2",
    "compiled_texts": "SELECT * FROM (VALUES " + ", ".join(f"({_quote(t)}, {_quote(f)}, {_quote(p)})" for t, f, p in TEXTS) + ") AS t(text, form, postfix)",
    "atom_alone": "SELECT id FROM items_nested WHERE len(list_filter(tags, lambda t: t.key = 'version' AND t.value LIKE '2____')) > 0",
    "hide_patterns": f"SELECT DISTINCT id, ns, key, value FROM tags WHERE NOT {_X9} AND key <> 'rank' AND NOT (ns IS NULL AND key = 'lang')",
    "hide_no_patterns": "SELECT DISTINCT id, ns, key, value FROM tags",
    "found_by_scenarios": "SELECT * FROM (VALUES " + ", ".join(f"({_quote(q)}, {_quote(i)})" for q, ids in SCENARIOS.items() for i in ids.split()) + ") AS t(query, id)",
    "to_nested": "SELECT i.id, count(DISTINCT (t.ns, t.key, t.value)) FILTER (t.id IS NOT NULL) AS n_tags FROM (SELECT DISTINCT id FROM store_items) i LEFT JOIN tags t USING (id) GROUP BY i.id",
    "to_long": "SELECT DISTINCT id, t.ns AS ns, t.key AS key, t.value AS value FROM items_nested, unnest(tags) AS u(t)",
    "line_round_trip": _ids("orders", f"{_has('priority', '4-NOT SPECIFIED')} AND NOT {_STATUS_F}"),
    "p4_found": f"WITH {_READ} SELECT id, col_name FROM cell WHERE NOT many GROUP BY id, col_name HAVING count(DISTINCT text) <> 1",
    "p4_failed": f"""WITH {_READ},
state AS (SELECT id, col_name, many, count(*) AS n_rows, count(text) AS n_read, count(DISTINCT text) AS n FROM cell GROUP BY ALL)
SELECT id, col_name, CASE WHEN n_read = 0 THEN 'unreadable' WHEN NOT many AND n > 1 THEN 'conflict' ELSE 'partly' END AS reason,
       n_rows, n_rows - n_read AS n_unread
FROM state WHERE n_read < n_rows OR NOT many AND n > 1""",
    "p4_wide": _wide_sql(),
    "p1_found": f"""WITH {_GRAINS}
SELECT grain, name FROM named GROUP BY grain, name HAVING count(*) >= 0.06 * (SELECT count(*) FROM writes)""",
    "p1_profile": f"""WITH {_GRAINS}
SELECT grain, name, count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(DISTINCT value) AS n_values
FROM named GROUP BY grain, name""",
}
