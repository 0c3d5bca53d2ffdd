"""Value objects and Spark schemas of the tag store."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class QueryError(ValueError):
    """A query that can't be compiled."""


class TagSyntaxError(QueryError):
    """A tag, line or atom that breaks the grammar."""


class Wild(Enum):
    """A quantifier in a position of an atom."""

    ANY = "*"
    SOME = "+"


_NUMERAL = re.compile("[-+]?[0-9]+([.][0-9]+)?")
_COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


@dataclass(frozen=True, slots=True)
class Tag:
    """The triple; ``None`` means absent, ``""`` means present and empty."""

    ns: str | None
    key: str
    value: str | None


Part = str | Wild


@dataclass(frozen=True, slots=True)
class Atom:
    """``ns:key op value``. ``ns`` is None for the null namespace; ``op`` and ``value``
    are both None for a bare existence test."""

    ns: Part | None
    key: Part
    op: str | None = None
    value: Part | None = None

    def matches(self, tags: Iterable[Tag]) -> bool:
        """Whether one of the tags matches: numbers only, no settings."""
        return any(self._places(t) and self._value(t.value) for t in tags)

    def _places(self, tag: Tag) -> bool:
        if isinstance(self.key, str) and self.key != tag.key:
            return False
        if isinstance(self.ns, Wild):
            return self.ns is Wild.ANY or tag.ns is not None
        return self.ns == tag.ns

    def _value(self, value: str | None) -> bool:
        if self.op is None or self.value is Wild.ANY:
            return True
        if value is None or self.value is Wild.SOME:
            return value is not None
        if self.op == "~":
            return len(value) == len(self.value) and all(p in (".", c) for p, c in zip(self.value, value, strict=True))
        if self.op in ("=", "!="):
            return (value == self.value) == (self.op == "=")
        if not (_NUMERAL.fullmatch(value) and _NUMERAL.fullmatch(self.value)):
            return False
        return _COMPARE[self.op](float(value), float(self.value))


#: Steps of a compiled query besides atoms.
AND, OR, NOT = "and", "or", "not"
OPERATORS = (AND, OR, NOT)

TAG_STRUCT = T.StructType(
    [T.StructField("ns", T.StringType()), T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]
)
WRITES = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("id", T.StringType()), *TAG_STRUCT.fields]
)
TAGS = T.StructType([T.StructField("id", T.StringType()), *TAG_STRUCT.fields])
NESTED = T.StructType([T.StructField("id", T.StringType()), T.StructField("tags", T.ArrayType(TAG_STRUCT))])
