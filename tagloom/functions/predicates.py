"""Atoms and hide patterns as Catalyst expressions over a tag's three columns.

Two kinds are kept apart. What an atom asks of a tag may be NULL where it can't be told,
which a filter takes for false; written so, it reaches the scan. Wherever an answer is
negated or kept as a flag it goes through :func:`sure` first, as ``not NULL`` loses rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.config import HidePattern, Target
from tagloom.functions.comparators import Comparator, compare_with
from tagloom.model import Atom, Wild

#: What a number looks like; compared as doubles. ``\z``, as ``$`` lets a newline through.
NUMERAL = r"\A[-+]?[0-9]+([.][0-9]+)?\z"


def balanced(combine: Callable[[Column, Column], Column], parts: Sequence[Column]) -> Column:
    """All parts combined as a flat tree: a chain of thousands is too deep for Catalyst."""
    if len(parts) == 1:
        return parts[0]
    half = len(parts) // 2
    return combine(balanced(combine, parts[:half]), balanced(combine, parts[half:]))


def any_of(conditions: Sequence[Column]) -> Column:
    return balanced(or_, conditions) if conditions else F.lit(False)


def sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def numeral(value: Column) -> Column:
    """The double a numeral stands for, else NULL. The guard is needed: a plain cast
    also reads ``5d``, ``1e5``, ``NaN`` and blanks."""
    return F.when(value.rlike(NUMERAL), value.try_cast("double"))


def compare(left: Column, op: str, right: Column) -> Column:
    """NULL where a side can't be interpreted."""
    return {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]


def _numeric(value: Column, op: str, literal: str, number: Column | None) -> Column:
    if not re.fullmatch(NUMERAL.replace("\\z", "\\Z"), literal):
        return F.lit(False)
    return compare(numeral(value) if number is None else number, op, F.lit(float(literal)))


def like_pattern(pattern: str) -> str:
    """``.`` is any one character, all else stands for itself."""
    return "".join("_" if c == "." else "\\" + c if c in "%_\\" else c for c in pattern)


def value_matches(atom: Atom, ns: Column, key: Column, value: Column, typed: Mapping[Target, Comparator], number: Column | None = None) -> Column:
    """number: the value as a double, where it is known to be a numeral."""
    if atom.op is None or atom.value is Wild.ANY:
        return F.lit(True)
    if atom.value is Wild.SOME:
        return value.isNotNull()
    if atom.op == "=":
        return value == F.lit(atom.value)
    if atom.op == "!=":
        return value != F.lit(atom.value)
    if atom.op == "~":
        return value.like(like_pattern(atom.value))
    asked = _numeric(value, atom.op, atom.value, number)
    # The tag's own target picks the comparator, so an atom over all namespaces may mix.
    for (t_ns, t_key), comparator in typed.items():
        if names_target(atom, t_ns, t_key):
            order = compare_with(comparator, value, atom.op, atom.value)
            if not isinstance(atom.ns, Wild) and isinstance(atom.key, str):
                return order  # the atom names this one target
            mine = (ns.isNull() if t_ns is None else sure(ns == F.lit(t_ns))) & sure(key == F.lit(t_key))
            asked = F.when(mine, order).otherwise(asked)
    return asked


def names_target(atom: Atom, ns: str | None, key: str) -> bool:
    """Whether the atom can reach tags of this target at all."""
    ns_ok = atom.ns is Wild.ANY or (ns is not None if atom.ns is Wild.SOME else atom.ns == ns)
    return ns_ok and (isinstance(atom.key, Wild) or atom.key == key)


def place_matches(atom: Atom, ns: Column, key: Column) -> Column:
    """The namespace and key part of an atom; plain comparisons, so that they reach the scan."""
    parts = []
    if atom.ns is None:
        parts.append(ns.isNull())
    elif atom.ns is Wild.SOME:
        parts.append(ns.isNotNull())
    elif atom.ns is not Wild.ANY:
        parts.append(ns == F.lit(atom.ns))
    if not isinstance(atom.key, Wild):
        parts.append(key == F.lit(atom.key))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def atom_matches(atom: Atom, tags: Column) -> Column:
    """Whether one of an array of tags matches the atom: numbers only, no settings."""
    one = lambda t: sure(place_matches(atom, t["ns"], t["key"]) & value_matches(atom, t["ns"], t["key"], t["value"], {}))
    return sure(F.exists(tags, one))


def pattern_covers(p: HidePattern, ns: Column, key: Column) -> Column:
    if p.ns is None:
        ns_ok = ns.isNull()
    elif isinstance(p.ns, str):
        ns_ok = sure((ns == F.lit(p.ns)) | ns.startswith(p.ns + "."))
    else:
        ns_ok = F.lit(True)
    return ns_ok if not isinstance(p.key, str) else ns_ok & sure(key == F.lit(p.key))


def hidden(patterns: tuple[HidePattern, ...], ns: Column, key: Column) -> Column:
    return any_of([pattern_covers(p, ns, key) for p in patterns])
