"""``python -m tagloom.cli parse TAG | compile QUERY | query [--postfix] QUERY < lines``

Exit status: 0 done, 1 a bad tag, line or query, 2 wrong use.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable

from tagloom.model import QueryError
from tagloom.parse import compile_infix, compile_postfix, compile_query, parse_tag

USAGE = "usage: parse TAG | compile QUERY | query [--postfix] QUERY < lines"


def _session():
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    return builder.config("spark.sql.shuffle.partitions", "8").getOrCreate()


def main(args: list[str], lines: Iterable[str] | None = None, out=None, spark=None) -> int:
    out = out or sys.stdout
    try:
        match args:
            case ["parse", text]:
                tag = parse_tag(text)
                for name, part in (("namespace", tag.ns), ("key", tag.key), ("value", tag.value)):
                    if part is not None:
                        print(f"{name}: {part}", file=out)
            case ["compile", text]:
                print(compile_infix(text), file=out)
            case ["query", text] | ["query", "--postfix", text] if text != "--postfix":
                query = (compile_postfix if len(args) == 3 else compile_query)(text)
                from tagloom.sources.lines import lines_of
                from tagloom.store import TagStore

                given = [x.rstrip("\r\n") for x in (sys.stdin if lines is None else lines)]
                writes, items = lines_of(spark or _session(), given)
                for row in TagStore.from_writes(writes, items).run(query).toLocalIterator():
                    print(row["id"], file=out)
            case _:
                print(USAGE, file=sys.stderr)
                return 2
    except QueryError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
