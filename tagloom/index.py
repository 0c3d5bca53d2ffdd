"""A small facade for interactive use: strings in, lists out, nothing of Spark shown."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tagloom import parse
from tagloom.store import TagStore


class Index:
    """``add`` lines, run queries, get sorted ids. Results are collected, so use
    :class:`TagStore` for results that don't fit the driver."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        self.store = TagStore.empty(spark or SparkSession.builder.getOrCreate())

    def add(self, line: str) -> None:
        self.store.add_line(line)

    def query(self, text: str) -> list[str]:
        return [r["id"] for r in self.store.query(text).collect()]

    def query_postfix(self, text: str) -> list[str]:
        return [r["id"] for r in self.store.query_postfix(text).collect()]

    def register_type(self, name: str, comparator) -> None:
        self.store.register_type(name, comparator)


def compile(text: str) -> str:
    """Infix to postfix."""
    return parse.compile_infix(text)


def parse_tag(text: str) -> dict[str, str | None]:
    t = parse.parse_tag(text)
    return {"namespace": t.ns, "key": t.key, "value": t.value}
