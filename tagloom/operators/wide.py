"""Attribute-value rows as one wide, typed row per entity.

Each (entity, attribute) pair is first resolved to a small state: least and greatest
readable value in canonical spelling, and how many rows were readable. That aggregate has
a map-side half, so an entity or attribute that holds a third of all rows is folded before
it moves. The resolved pairs of an entity then become one key-value map, from which the
known attributes are projected into typed columns. What couldn't be read stays in
``failed``, with the reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most attributes of a wide table; a larger catalogue is refused, as it is its schema.
MAX_ATTRIBUTES = 2_000
FAILED = "failed"

_DAY = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
_CLOCK = "(?:[01][0-9]|2[0-3]):[0-5][0-9]"
_STAMP = rf"\A({_DAY})T({_CLOCK}:[0-5][0-9])(Z|[+-]{_CLOCK})\z"


def _instant(text: Column) -> Column:
    """Seconds since 1970 of ``YYYY-MM-DDTHH:MM:SS`` and a zone, NULL if it is none."""
    part = lambda a, n: F.substring(text, a, n).try_cast("int")
    day = F.unix_date(F.substring(text, 1, 10).try_cast("date")).cast("bigint")
    clock = part(12, 2) * 3600 + part(15, 2) * 60 + part(18, 2)
    shift = F.when(F.substring(text, 20, 1) == "Z", 0).otherwise(
        F.when(F.substring(text, 20, 1) == "-", -1).otherwise(1) * (part(21, 2) * 3600 + part(24, 2) * 60)
    )
    return F.when(text.rlike(_STAMP), day * 86400 + clock - shift)


def _double(text: Column) -> Column:
    d = F.when(text.rlike(r"\A[+-]?[0-9]+(?:[.][0-9]+)?\z"), text.try_cast("double"))
    return F.when(d == 0, F.lit(0.0)).otherwise(d)  # one zero


#: How a type's text is read (NULL: unreadable) and how its canonical spelling is typed.
READERS = {
    "string": lambda t: t,
    "bigint": lambda t: F.when(t.rlike(r"\A[+-]?[0-9]+\z"), t.try_cast("bigint")),
    "double": _double,
    "boolean": lambda t: F.when(t.rlike(r"\A(?i:true|false)\z"), F.lower(t)),
    "date": lambda t: F.when(t.rlike(rf"\A{_DAY}\z"), t.try_cast("date")),
    "timestamp": _instant,
}
_TYPED = {"string": lambda c: c, "timestamp": lambda c: F.timestamp_seconds(c.cast("bigint"))}


def canonical(kind: Column, text: Column) -> Column:
    """One spelling per typed value."""
    out = F.lit(None).cast("string")
    for name, read in READERS.items():
        out = F.when(kind == name, read(text).cast("string")).otherwise(out)
    return out


def typed(kind: str, text: Column) -> Column:
    return _TYPED.get(kind, lambda c: c.cast(kind))(text)


@dataclass(frozen=True)
class Attribute:
    ns: str | None
    key: str
    column: str
    kind: str
    many: bool


def read_catalog(catalog: DataFrame) -> list[Attribute]:
    """The catalogue, as it names the columns. Refused: an unknown type, two columns of
    one name, or a column called ``id`` or ``failed``."""
    rows = catalog.select("ns", "key", "col_name", "col_type", "many").orderBy("attr_id").limit(MAX_ATTRIBUTES + 1).collect()
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    out = [Attribute(r["ns"], r["key"], r["col_name"], r["col_type"], bool(r["many"])) for r in rows]
    names = [a.column.lower() for a in out]
    if len({*names, "id", FAILED}) != len(names) + 2:
        raise ValueError("column names clash")
    if unknown := {a.kind for a in out} - READERS.keys():
        raise ValueError(f"unknown types {sorted(unknown)}")
    return out


def resolved_pairs(tags: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """``(id, attr, low, high, n_rows, n_read, several)`` of every pair that has a row."""
    local = tags.sparkSession.createDataFrame(
        [(i, a.ns, a.key, a.kind, a.many) for i, a in enumerate(attributes)], "attr int, a_ns string, a_key string, kind string, many boolean"
    )
    own = tags.select("id", "ns", "key", "value").filter(F.col("id").isNotNull())
    met = own.join(F.broadcast(local), (F.col("key") == F.col("a_key")) & F.col("ns").eqNullSafe(F.col("a_ns")))
    read = met.select("id", "attr", "many", canonical(F.col("kind"), F.col("value")).alias("text"))
    one = F.when(~F.col("many"), F.col("text"))
    return read.groupBy("id", "attr").agg(
        F.min(one).alias("low"),
        F.max(one).alias("high"),
        F.count("*").alias("n_rows"),
        F.count("text").alias("n_read"),
        F.collect_set(F.when(F.col("many"), F.col("text"))).alias("several"),
    )


def widen(tags: DataFrame, items: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per id of ``items``: typed columns, arrays (sorted, without repeats) where
    the catalogue says many, and ``failed``: column to (reason, n_rows, n_unread).

    A column is NULL where the item has no row for it, where no value is readable
    (``unreadable``) or where readable values differ (``conflict``); an array column is
    NULL if nothing was readable. ``partly`` marks a cell that has its value, or values,
    but also rows that couldn't be read. An absent value is never readable. ``''`` is a
    string. NULL ids are dropped; ids only in ``tags`` give no row; repeated ids give one.
    """
    attributes = read_catalog(catalog)
    # Most pairs are one value and nothing else; the rest of the state travels only with
    # those that hold several, or rows that couldn't be read.
    plain = (F.size("several") == 0) & (F.col("n_read") == F.col("n_rows")) & (F.col("low") == F.col("high"))
    more = F.when(~F.coalesce(plain, F.lit(False)), F.struct("high", "n_rows", "n_read", "several"))
    pairs = resolved_pairs(tags, attributes).select("id", "attr", F.struct("low", more.alias("more")).alias("state"))
    # Pairs are one row per attribute by now, so no id is large; as plain rows they move with
    # less than half the bytes of collected lists.
    maps = pairs.repartition("id").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("attr", "state"))).alias("of"))
    rows = items.select("id").filter(F.col("id").isNotNull()).distinct().join(maps, "id", "left")

    def cell(i: int) -> Column:
        return F.col("of")[F.lit(i)]

    def column(i: int, a: Attribute) -> Column:
        c = cell(i)
        if a.many:
            values = F.array_sort(F.transform(c["more"]["several"], lambda t: typed(a.kind, t)))
            return F.when(F.size(values) > 0, values).alias(a.column)
        one = c["more"].isNull() | (c["more"]["high"] == c["low"])
        return F.when(one, typed(a.kind, c["low"])).alias(a.column)

    # Failures come from the pairs that an item has, however many attributes there are.
    names = F.array(*[F.lit(a.column) for a in attributes]).cast("array<string>")
    many = F.array(*[F.lit(a.many) for a in attributes]).cast("array<boolean>")

    def failure(e: Column) -> Column:
        more = e["value"]["more"]
        conflict = ~F.get(many, e["key"]) & (more["high"] != e["value"]["low"])
        reason = F.when(more["n_read"] == 0, "unreadable").when(conflict, "conflict").when(more["n_read"] < more["n_rows"], "partly")
        why = F.struct(reason.alias("reason"), more["n_rows"].alias("n_rows"), (more["n_rows"] - more["n_read"]).alias("n_unread"))
        return F.struct(F.get(names, e["key"]).alias("key"), why.alias("value"))

    doubtful = F.filter(F.map_entries("of"), lambda e: e["value"]["more"].isNotNull())
    failures = F.filter(F.transform(doubtful, failure), lambda e: e["value"]["reason"].isNotNull())
    none = F.array().cast("array<struct<key:string,value:struct<reason:string,n_rows:bigint,n_unread:bigint>>>")
    failed = F.map_from_entries(F.coalesce(failures, none)).alias(FAILED)
    return rows.select("id", *[column(i, a) for i, a in enumerate(attributes)], failed)


def failed_cells(tags: DataFrame, items: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(id, col_name)`` of the single-valued cells that have rows but no one value."""
    single = [a.column for a in read_catalog(catalog) if not a.many]
    cells = widen(tags, items, catalog).select("id", F.explode(FAILED).alias("col_name", "why"))
    return cells.filter(F.col("col_name").isin(single) & (F.col("why.reason") != "partly")).select("id", "col_name")
