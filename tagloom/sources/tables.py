"""Ordinary tables seen as tagged items.

:class:`TagColumns` says which columns are which tags. A query over it becomes a predicate
on those columns, so it reaches the table's own scan and reads no other column.
``tag_table`` and ``tag_items`` spell the tags out, for whatever needs them as rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.model import NESTED, TAG_STRUCT


@dataclass(frozen=True)
class TagOf:
    """One tag per row: a fixed ns and key, and a value column (None: valueless).
    The tag is left out where ``when`` isn't true, or where a given value is NULL.
    ``number`` is the value as a double, NULL where it is no numeral. ``has``: whether there is
    a value, where that is asked of a row more cheaply than for its text."""

    key: str
    value: Column | None = None
    ns: str | None = None
    when: Column | None = None
    number: Column | None = None
    has: Column | None = None

    @property
    def text(self) -> Column:
        return (F.lit(None) if self.value is None else self.value).cast("string")

    def present(self, asked: Column | None = None) -> Column:
        """Whether a row has this tag, and it is as asked."""
        given = None if self.value is None else self.value.isNotNull() if self.has is None else self.has
        conditions = [c for c in (self.when, given, asked) if c is not None]
        return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def number_tag(key: str, column: str, ns: str | None = None, scale: int = 2) -> TagOf:
    """A number as plain digits: doubles would print an exponent from 1e7 on. One that fits no
    38 digits, or is none, is a tag too, with the text it has of itself, and no numeral."""
    narrow, wide = (F.col(column).try_cast(f"decimal({digits},{scale})") for digits in (18, 38))
    text = F.coalesce(narrow.cast("string"), wide.cast("string"), F.col(column).cast("string"))
    return TagOf(key, text, ns, number=F.coalesce(narrow.cast("double"), wide.cast("double")), has=F.col(column).isNotNull())


def _tags(specs: Sequence[TagOf]) -> Column:
    def one(s: TagOf) -> Column:
        tag = F.struct(F.lit(s.ns).cast("string").alias("ns"), F.lit(s.key).alias("key"), s.text.alias("value")).cast(TAG_STRUCT)
        return tag if s.when is None and s.value is None else F.when(s.present(), tag)

    return F.filter(F.array(*map(one, specs)), lambda t: t.isNotNull())


@dataclass(frozen=True)
class TagColumns:
    """A table whose rows are tags of items. one_row: no two rows are of one item."""

    rows: DataFrame
    id: Column
    specs: Sequence[TagOf]
    one_row: bool = False

    def long(self) -> DataFrame:
        return tag_table(self.rows, self.id, self.specs)

    def nested(self) -> DataFrame:
        return tag_items(self.rows, self.id, self.specs)


def tag_table(rows: DataFrame, id: Column, specs: Sequence[TagOf]) -> DataFrame:
    """Long form ``(id, ns, key, value)``: several rows may speak of one item. One branch
    per tag with its namespace and key as constants, so a query that names them keeps that
    branch alone, and its filter reaches the scan."""

    def branch(s: TagOf) -> DataFrame:
        kept = rows if s.when is None and s.value is None else rows.filter(s.present())
        return kept.select(id.cast("string").alias("id"), F.lit(s.ns).cast("string").alias("ns"), F.lit(s.key).alias("key"), s.text.alias("value"))

    return reduce(DataFrame.union, map(branch, specs))


def tag_items(rows: DataFrame, id: Column, specs: Sequence[TagOf]) -> DataFrame:
    """Nested form for tables with one row per item; queries on it need no shuffle."""
    return rows.select(id.cast("string").alias("id"), _tags(specs).cast(NESTED["tags"].dataType).alias("tags"))
