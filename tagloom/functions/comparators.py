"""Orders for values the numeral grammar can't order.

A comparator is either *native*, a function from a string column to a sortable column
(NULL where the text isn't of the type), or a Python function ``(a, b) -> int | None``.
Native ones stay inside generated code; Python ones run as a pandas UDF that calls the
function once per distinct value of a batch.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Widest number of a version part (fixed value: unsigned 64 bits).
MAX_PART = 2**64 - 1
_WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class Comparator:
    """sort_key: native form. function: Python form, returning None if not comparable."""

    sort_key: Callable[[Column], Column] | None = None
    function: Callable[[str, str], int | None] | None = None


def _number(text: Column, pattern: str) -> Column:
    """A number of at most 64 bits, else NULL. Zeros in front don't count as width."""
    bare = F.regexp_replace(text, r"\A[+]?0*(?=[0-9])", "")
    n = F.when(text.rlike(pattern) & (F.length(bare) <= 20), bare.try_cast(_WIDE))
    return F.when(n <= F.lit(str(MAX_PART)).cast(_WIDE), n)


def version_key(text: Column) -> Column:
    """Dotted numbers of any count, compared one by one; fewer parts come first."""
    parts = F.transform(F.split(text, "[.]", -1), lambda p: _number(p, r"\A[+]?[0-9]+\z"))
    return F.when(~F.exists(parts, lambda p: p.isNull()), parts)


def semver_key(text: Column) -> Column:
    """Semantic versions: three numbers, then a release after all its pre-releases.
    Numeric identifiers come before others; build metadata doesn't count."""
    plain = F.substring_index(text, "+", 1)
    core = F.substring_index(plain, "-", 1)
    has_pre = F.length(plain) > F.length(core)
    numbers = F.transform(F.split(core, "[.]", -1), lambda p: _number(p, r"\A[+]?[0-9]+\z"))
    pre = F.when(has_pre, F.substring(plain, F.length(core) + 2, F.length(plain))).otherwise(F.lit("0"))

    def identifier(p: Column) -> Column:
        digits = p.rlike(r"\A[0-9]+\z")
        n = _number(p, r"\A[0-9]+\z")
        good = F.when(digits, n.isNotNull()).otherwise(p.rlike(r"\A[0-9A-Za-z-]+\z"))
        return F.when(
            good,
            F.struct(
                F.when(digits, 0).otherwise(1).alias("kind"),
                F.when(digits, n).otherwise(F.lit(0).cast(_WIDE)).alias("number"),
                F.when(digits, F.lit("")).otherwise(p).alias("text"),
            ),
        )

    ids = F.transform(F.split(pre, "[.]", -1), identifier)
    ok = (F.size(numbers) == 3) & ~F.exists(numbers, lambda p: p.isNull()) & ~F.exists(ids, lambda p: p.isNull())
    return F.when(ok, F.struct(numbers.alias("core"), F.when(has_pre, 0).otherwise(1).alias("final"), ids.alias("pre")))


SEMVER = Comparator(sort_key=semver_key)
VERSION = Comparator(sort_key=version_key)


_ORDERS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def compare_with(comparator: Comparator, value: Column, op: str, literal: str) -> Column:
    """Whether value stands in the order op to literal, NULL if they aren't comparable."""
    order = _ORDERS[op]
    if comparator.sort_key is not None:
        return order(comparator.sort_key(value), comparator.sort_key(F.lit(literal)))
    function = comparator.function

    @F.pandas_udf(BooleanType())
    def holds(values: pd.Series) -> pd.Series:
        def one(v: str) -> bool | None:
            r = function(v, literal)
            return None if r is None else order(r, 0)

        seen = {v: one(v) for v in values.dropna().unique()}
        return values.map(seen).astype("boolean")

    return holds(value)
