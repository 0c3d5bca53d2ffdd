"""The store: where tags come from, and the queries over them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.checkpoints import saved
from tagloom.config import ROOT_NS, HideConfig, StoreConfig, hide_ns, type_ns
from tagloom.functions.comparators import Comparator
from tagloom.functions.predicates import hidden
from tagloom.model import TAGS, WRITES, Atom, Tag
from tagloom.operators.collapse import live_tags
from tagloom.parse import Query, compile_postfix, compile_query, parse_atom, parse_line
from tagloom.plans.planner import STRATEGIES, Plan
from tagloom.sources.layout import to_nested
from tagloom.sources.tables import TagColumns

#: Most settings a store may hold; more is refused, as they shape the plan on the driver.
MAX_SETTINGS = 100_000


def settings_root(tags: DataFrame) -> str:
    """The root below which tags keep their settings, as far as they show it: that of the
    namespaces ``<root>.hide`` and ``<root>.arity`` that hold a setting's value. Without any
    it is the usual one; several are refused."""
    shows = [("hide", ("true", "false")), ("arity", ("scalar", "set"))]
    said = reduce(lambda a, b: a | b, [F.col("ns").endswith(f".{kind}") & F.col("value").isin(*values) for kind, values in shows])
    rows = tags.filter(said).select(F.regexp_extract("ns", r"\A(.+)[.](?:hide|arity)\z", 1).alias("root")).distinct().limit(2).collect()
    if len(rows) > 1:
        raise ValueError(f"settings below several roots: {sorted(r['root'] for r in rows)}")
    return rows[0]["root"] if rows else ROOT_NS


class TagStore:
    """Items with tags, from a write log, from live tags, or from nested items. root names the
    namespace below which the store's settings are kept.

    >>> store = TagStore.from_writes(spark.read.parquet("writes.parquet"))
    >>> store.query("topic=nimel and not sys:state=idle")        # DataFrame(id)
    """

    def __init__(self, spark: SparkSession, *, writes: DataFrame | None = None, tags: DataFrame | None = None, nested: DataFrame | None = None, tables: Sequence[TagColumns] = (), items: DataFrame | None = None, root: str = ROOT_NS) -> None:
        self.spark, self.root = spark, root
        self._writes, self._tags, self._nested, self._items = writes, tags, nested, items
        self._tables = tuple(tables)
        self._pending: list[tuple] = []
        self._bare_ids: list[str] = []
        self._next_seq: int | None = None
        self._types: dict[str, Comparator] = {}
        self._config: StoreConfig | None = None

    @classmethod
    def empty(cls, spark: SparkSession, root: str = ROOT_NS) -> TagStore:
        return cls(spark, writes=spark.createDataFrame([], WRITES), root=root)

    @classmethod
    def from_writes(cls, writes: DataFrame, items: DataFrame | None = None, root: str = ROOT_NS) -> TagStore:
        """An append-only log in the order of (seq, pos); scalar keys are collapsed."""
        return cls(writes.sparkSession, writes=writes, items=items, root=root)

    @classmethod
    def from_tags(cls, tags: DataFrame, items: DataFrame | None = None, root: str = ROOT_NS) -> TagStore:
        """Live state, nothing left to collapse. Repeated rows don't matter. Of tags in the
        bucketed layout a query reads the buckets it names."""
        return cls(tags.sparkSession, tags=tags, items=items, root=root)

    @classmethod
    def from_nested(cls, nested: DataFrame, root: str = ROOT_NS) -> TagStore:
        return cls(nested.sparkSession, nested=nested, root=root)

    @classmethod
    def from_columns(cls, *tables: TagColumns, root: str = ROOT_NS) -> TagStore:
        """Ordinary tables, one or more, whose columns are tags of items."""
        return cls(tables[0].rows.sparkSession, tables=tables, root=root)

    def settled(self) -> TagStore:
        """A store of the live state, worked out now and kept in the shared folder: a log is
        collapsed once for many queries. Later writes to this store aren't in it."""
        made = TagStore.from_tags(saved(self.tags.select(*TAGS.fieldNames())), self.all_ids(), self.root)
        made._config, made._types = self.config, dict(self._types)
        return made

    # Writing: small appends from the driver; bulk loads go through tagloom.sources.

    def add_item(self, id: str, tags: Iterable[Tag]) -> None:
        """One write: a batch of tags of one item. A setting in it counts from the next one."""
        if self._writes is None:
            raise ValueError("this store has no write log")
        if self._next_seq is None:
            top = self._writes.agg(F.max("seq")).first()[0]
            self._next_seq = 1 if top is None else top + 1
        rows = [(self._next_seq, i, id, t.ns, t.key, t.value) for i, t in enumerate(tags)]
        self._pending.extend(rows)
        self._bare_ids.append(id)
        self._next_seq += 1
        self._config = None

    def add_line(self, line: str) -> None:
        self.add_item(*parse_line(line))

    def register_type(self, name: str, comparator: Comparator | Callable[[str, str], int | None]) -> None:
        """Give the values of targets declared as this type an order. Replaces an older one."""
        self._types[name] = comparator if isinstance(comparator, Comparator) else Comparator(function=comparator)

    # Reading.

    @property
    def writes(self) -> DataFrame:
        if self._writes is None:
            raise ValueError("this store has no write log")
        own = self._writes.select(*WRITES.fieldNames())
        return own.unionByName(self.spark.createDataFrame(self._pending, WRITES)) if self._pending else own

    @property
    def tags(self) -> DataFrame:
        """Live state, one row per item and tag (a nested store: one per stored tag)."""
        if self._writes is not None:
            return live_tags(self.writes, self.root)
        if self._tags is not None:
            return self._tags
        if self._tables:
            return reduce(DataFrame.unionByName, [t.long() for t in self._tables])
        return self._nested.select("id", F.inline("tags")).select(*TAGS.fieldNames())

    @property
    def nested(self) -> DataFrame:
        return self._nested if self._nested is not None else to_nested(self.tags)

    def all_ids(self) -> DataFrame:
        """Every id ever added, in order, those without tags too."""
        if self._nested is not None:
            ids = self._nested.select("id")
        else:
            ids = (self.writes if self._writes is not None else self.tags).select("id")
        if self._items is not None:
            ids = ids.union(self._items.select("id"))
        if self._bare_ids:
            ids = ids.union(self.spark.createDataFrame([(i,) for i in self._bare_ids], "id string"))
        return ids.filter(F.col("id").isNotNull()).distinct().orderBy("id")

    @property
    def config(self) -> StoreConfig:
        """Settings ever written, also those a later write collapsed."""
        reserved = (hide_ns(self.root), type_ns(self.root))
        if self._config is None and not any(s.ns in reserved for t in self._tables for s in t.specs) and self._tables:
            self._config = StoreConfig.from_tags((), self.root)  # columns are known, none is a setting
        if self._config is None:
            source = self.writes if self._writes is not None else self.tags
            rows = (
                source.filter(F.col("ns").isin(*reserved) & F.col("value").isNotNull() & F.col("key").isNotNull())
                .select("ns", "key", "value").distinct().limit(MAX_SETTINGS + 1).collect()
            )
            if len(rows) > MAX_SETTINGS:
                raise ValueError(f"more than {MAX_SETTINGS} settings")
            self._config = StoreConfig.from_tags((Tag(*r) for r in rows), self.root)
        return self._config

    def hide_config(self) -> HideConfig:
        return self.config.hide

    def plan(self, query: Query) -> Plan:
        typed = {t: self._types[n] for t, n in self.config.types.items() if n in self._types}
        return Plan(query, self.config.hide, typed)

    def run(self, query: Query, strategy: str = "auto", ordered: bool = True) -> DataFrame:
        """Ids that answer, each once, in ascending order of bytes. Without ``ordered`` they
        come in any order, which saves a large result its sort."""
        plan = self.plan(query)
        if strategy == "auto":
            strategy = "columns" if self._tables else "nested" if self._nested is not None else "fused"
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy {strategy!r} is none of {STRATEGIES}")
        if strategy == "nested" and any(c.sort_key is None for c in plan.typed.values()):
            strategy = "fused"  # Spark takes no Python function inside a lambda
        if strategy == "columns":
            if not self._tables:
                raise ValueError("this store isn't made of tables")
            ids = plan.columns(self._tables)
        elif strategy == "nested":
            ids = plan.nested(self.nested)
        else:
            # Only what a query can depend on is collapsed.
            tags = self.tags if self._writes is None else live_tags(self.writes, self.root, plan.places())
            ids = getattr(plan, strategy)(tags)
        ids = ids.filter(F.col("id").isNotNull())
        if strategy == "nested" or strategy == "columns" and self._tables[0].one_row:
            # That an item is one row isn't checked anywhere. A sort samples what it sorts, that
            # is, it works it out once more: from memory at no cost, but a scan should end in
            # the exchange that drops repeats, before the sort.
            at_hand = strategy == "nested" and self._nested is not None and self._nested.is_cached
            ids = ids.repartitionByRange("id").distinct() if at_hand and ordered else ids.distinct()
        return ids.orderBy("id") if ordered else ids

    def query(self, text: str, strategy: str = "auto", ordered: bool = True) -> DataFrame:
        return self.run(compile_query(text), strategy, ordered)

    def query_postfix(self, text: str, strategy: str = "auto", ordered: bool = True) -> DataFrame:
        return self.run(compile_postfix(text), strategy, ordered)

    def matching_ids(self, atom: str | Atom, strategy: str = "auto", ordered: bool = True) -> DataFrame:
        """Items with a tag that matches one atom."""
        atom = parse_atom(atom) if isinstance(atom, str) else atom
        return self.run(Query("", (atom,)), strategy, ordered)

    def participating(self, *references: str) -> DataFrame:
        """Items with a tag that is visible to a query of these atoms: the set that
        ``not`` complements against."""
        plan = self.plan(Query("", tuple(map(parse_atom, references))))
        return self.tags.filter(plan.visible(F.col("ns"), F.col("key"))).select("id").distinct().orderBy("id")

    def displayed(self) -> DataFrame:
        """The live tags that aren't hidden, without any query to reveal them."""
        return self.tags.select(*TAGS.fieldNames()).filter(~self.hidden_column()).distinct()

    def hidden_column(self, ns: str | Column = "ns", key: str | Column = "key") -> Column:
        as_column = lambda c: F.col(c) if isinstance(c, str) else c
        return hidden(self.config.hide.patterns, as_column(ns), as_column(key))
