"""From a compiled query to a DataFrame of item ids.

An item answers a query iff it participates and the boolean expression over "has a tag
that matches atom i" holds. That gives four plans for the same answer:

``fused``    one scan of the long table, one aggregate with a flag per distinct atom; of the
             bucketed layout it reads the buckets that the atoms name;
``nested``   higher-order filters over ``items(id, tags[])``, without any shuffle;
``posting``  one narrow scan per atom and semi/anti joins, for few selective atoms;
``columns``  atoms become predicates on the columns of ordinary tables, so filters and the
             choice of columns reach their scans and no tag is ever built.

Which settings hide a tag is decided on the driver, as what a query reveals is a
property of the pattern and not of the tag.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.config import HideConfig, HidePattern, Target, reference_of
from tagloom.functions.comparators import Comparator
from tagloom.functions.predicates import any_of, balanced, hidden, names_target, place_matches, sure, value_matches
from tagloom.model import AND, NOT, OR, Atom, Wild
from tagloom.parse import Query
from tagloom.sources.layout import BUCKET, bucket_of, clustered
from tagloom.sources.tables import TagColumns

STRATEGIES = ("fused", "nested", "posting", "columns")


@dataclass(frozen=True)
class Plan:
    query: Query
    hide: HideConfig
    typed: Mapping[Target, Comparator]

    @property
    def positive(self) -> bool:
        """Whether only items that match some atom can answer, so that participation
        follows from the match. Signs are those of De Morgan's rules."""
        signs: list[bool] = []
        for step in self.query.program:
            if isinstance(step, Atom):
                signs.append(True)
            elif step == NOT:
                signs.append(not signs.pop())
            else:
                b, a = signs.pop(), signs.pop()
                signs.append(a or b if step == AND else a and b)
        return signs[0]

    def boolean(self, leaf) -> Column:
        """The expression over what leaf gives for each atom. Runs of one operator are
        gathered and combined flat."""
        merge = {AND: operator.and_, OR: operator.or_}
        stack: list[tuple[str, list[Column]]] = []

        def one(part: tuple[str, list[Column]]) -> Column:
            return balanced(merge[part[0]], part[1])

        for step in self.query.program:
            if isinstance(step, Atom):
                stack.append((AND, [leaf(step)]))
            elif step == NOT:
                stack.append((AND, [~one(stack.pop())]))
            else:
                b, a = stack.pop(), stack.pop()
                stack.append((step, [c for part in (a, b) for c in (part[1] if part[0] == step or len(part[1]) == 1 else [one(part)])]))
        return one(stack[0])

    def necessary(self, leaf) -> Column | None:
        """What a row must meet to answer, without any negation, so that it may reach the
        scan as it stands; None if nothing can be said. Each step holds what must be met
        for it to be true and for it to be false."""
        join = lambda a, b: b if a is None else a if b is None else a & b
        either = lambda a, b: None if a is None or b is None else a | b
        stack: list[tuple[Column | None, Column | None]] = []
        for step in self.query.program:
            if isinstance(step, Atom):
                stack.append((leaf(step), None))
            elif step == NOT:
                stack.append(stack.pop()[::-1])
            else:
                (b_true, b_false), (a_true, a_false) = stack.pop(), stack.pop()
                stack.append((join(a_true, b_true), either(a_false, b_false)) if step == AND else (either(a_true, b_true), join(a_false, b_false)))
        return stack[0][0]

    def visible(self, ns: Column, key: Column) -> Column:
        """Whether a tag makes its item participate: the references of all atoms count."""
        return ~hidden(self.hide.unrevealed(map(reference_of, self.query.atoms)), ns, key)

    def hidden_from(self, atom: Atom) -> tuple[HidePattern, ...]:
        """The patterns the atom itself doesn't reveal."""
        return self.hide.unrevealed([reference_of(atom)])

    def matches(self, atom: Atom, ns: Column, key: Column, value: Column) -> Column:
        """Whether a tag answers the atom (NULL: no): only the atom's own reference counts."""
        left = self.hidden_from(atom)
        if isinstance(atom.ns, str | None) and isinstance(atom.key, str):
            if any(p.covers(atom.ns, atom.key) for p in left):
                return F.lit(False)
            left = ()
        asked = place_matches(atom, ns, key) & value_matches(atom, ns, key, value, self.typed)
        return asked & ~hidden(left, ns, key) if left else asked

    def _by_id(self, hits: DataFrame) -> DataFrame:
        """Rows of an id and flags to the ids that answer."""
        by_id = hits.groupBy("id").agg(*[F.max(c).alias(c) for c in hits.columns if c != "id"])
        answer = self.boolean(lambda a: F.col(self._flags[a]))
        return by_id.filter(answer if self.positive else answer & F.col("seen")).select("id")

    @property
    def _flags(self) -> dict[Atom, str]:
        return {a: f"m{i}" for i, a in enumerate(self.query.atoms)}

    def _hits(self, rows: DataFrame, id: Column, conditions: dict[Atom, Column], seen: Column) -> DataFrame:
        """Only rows that can matter, with one flag per atom."""
        kept = rows.filter(any_of([*conditions.values(), *([] if self.positive else [seen])]))
        flags = [sure(c).alias(self._flags[a]) for a, c in conditions.items()]
        return kept.select(id.alias("id"), *flags, *([] if self.positive else [sure(seen).alias("seen")]))

    def places(self) -> Column:
        """The namespaces and keys on which the answer can depend at all."""
        ns, key = F.col("ns"), F.col("key")
        return any_of([*[place_matches(a, ns, key) for a in self.query.atoms], *([] if self.positive else [self.visible(ns, key)])])

    def buckets(self, tags: DataFrame) -> Column | None:
        """The buckets that can hold a match; None if all have to be read."""
        exact = all(isinstance(a.ns, str | None) and isinstance(a.key, str) for a in self.query.atoms)
        if not (clustered(tags) and exact and self.positive):
            return None
        return any_of([F.col(BUCKET) == bucket_of(tags, *place) for place in dict.fromkeys((a.ns, a.key) for a in self.query.atoms)])

    def fused(self, tags: DataFrame) -> DataFrame:
        named = self.buckets(tags)
        tags = tags if named is None else tags.filter(named)
        ns, key, value = F.col("ns"), F.col("key"), F.col("value")
        conditions = {a: self.matches(a, ns, key, value) for a in self.query.atoms}
        if self.positive and len(self.query.program) == 1:
            return tags.filter(any_of([*conditions.values()])).select("id").distinct()
        return self._by_id(self._hits(tags, F.col("id"), conditions, self.visible(ns, key)))

    def columns(self, tables: Sequence[TagColumns]) -> DataFrame:
        def asks(table: TagColumns, atom: Atom) -> Column:
            left = self.hidden_from(atom)
            able = [s for s in table.specs if names_target(atom, s.ns, s.key) and not any(p.covers(s.ns, s.key) for p in left)]
            ns = lambda s: F.lit(s.ns).cast("string")
            return any_of([s.present(value_matches(atom, ns(s), F.lit(s.key), s.text, self.typed, s.number)) for s in able])

        open_ = self.hide.unrevealed(map(reference_of, self.query.atoms))
        hits = []
        for t in tables:
            conditions = {a: asks(t, a) for a in self.query.atoms}
            seen = any_of([s.present() for s in t.specs if not any(p.covers(s.ns, s.key) for p in open_)])
            if len(tables) == 1 and t.one_row:
                must = self.necessary(conditions.get)
                rows = t.rows if must is None else t.rows.filter(must)
                answer = self.boolean(lambda a: sure(conditions[a]))  # noqa: B023
                return rows.filter(answer if self.positive else answer & sure(seen)).select(t.id.alias("id"))
            hits.append(self._hits(t.rows, t.id, conditions, seen))
        return self._by_id(reduce(DataFrame.unionByName, hits))

    def nested(self, items: DataFrame) -> DataFrame:
        tags = F.coalesce(F.col("tags"), F.array().cast(items.schema["tags"].dataType))
        has = lambda test: F.exists(tags, lambda t: test(t["ns"], t["key"], t["value"]))
        answer = self.boolean(lambda a: has(lambda n, k, v: sure(self.matches(a, n, k, v))))
        if not self.positive:
            answer = answer & has(lambda n, k, _: self.visible(n, k))
        return items.filter(answer).select("id")

    def posting(self, tags: DataFrame) -> DataFrame:
        """Frames are (ids, complement?) pairs; a complement is never materialised
        before the end, and then only against the participating items."""
        ns, key, value = F.col("ns"), F.col("key"), F.col("value")

        def scan(atom: Atom) -> DataFrame:
            rows = tags
            if clustered(tags) and isinstance(atom.ns, str | None) and isinstance(atom.key, str):
                rows = rows.filter(F.col(BUCKET) == bucket_of(tags, atom.ns, atom.key))
            return rows.filter(self.matches(atom, ns, key, value)).select("id").distinct()

        frames: list[tuple[DataFrame, bool]] = []
        for step in self.query.program:
            if isinstance(step, Atom):
                frames.append((scan(step), False))
            elif step == NOT:
                ids, flipped = frames.pop()
                frames.append((ids, not flipped))
            else:
                (b, b_not), (a, a_not) = frames.pop(), frames.pop()
                if step != AND:  # a or b = not (not a and not b)
                    a_not, b_not = not a_not, not b_not
                if a_not and b_not:
                    frames.append((a.union(b).distinct(), True))
                elif a_not or b_not:
                    keep, drop = (b, a) if a_not else (a, b)
                    frames.append((keep.join(drop, "id", "left_anti"), False))
                else:
                    frames.append((a.join(b, "id", "left_semi"), False))
                if step != AND:
                    ids, flipped = frames.pop()
                    frames.append((ids, not flipped))
        ids, flipped = frames[0]
        if not flipped:
            return ids
        return tags.filter(self.visible(ns, key)).select("id").distinct().join(ids, "id", "left_anti")
