"""Reading and writing tags: lines, JSON lines, Parquet logs, id lists.

A line is ``<id> <tag> <tag>…``, split at unquoted Unicode white space. All of it is done by
built-in expressions inside the scan's stage; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom import lex
from tagloom.model import NESTED, TAG_STRUCT, WRITES
from tagloom.parse import parse_line

MODES = ("failfast", "permissive", "dropmalformed")
_TAG = lex.TAG_PATTERN_JVM


def split_column(text: Column) -> Column:
    """Fields of a line; NULL for a line with an unterminated quote."""
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    return F.when(quotes % 2 == 0, F.regexp_extract_all(text, F.lit(lex.FIELD_PATTERN), F.lit(0)))


def tag_columns(fields: Column) -> Column:
    """The tags an array of texts stands for; one that is no tag gives NULL parts. Each
    pattern runs once per text: what it found is bound before it is decoded."""
    found = F.transform(fields, lambda t: F.array(*[F.regexp_extract(t, _TAG, k) for k in (1, 2, 3)]))

    def decoded(raw: Column) -> Column:
        plain = F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))
        # An absent group is '', a present empty token is '""'.
        return F.when(raw == "", F.lit(None)).when(raw.startswith('"'), plain).otherwise(raw)

    return F.transform(found, lambda g: F.struct(*[decoded(F.get(g, F.lit(k))).alias(n) for k, n in enumerate(TAG_STRUCT.fieldNames())])).cast(NESTED["tags"].dataType)


def parse_lines(lines: DataFrame, mode: str = "failfast", text: str = "value", seq: str = "seq") -> DataFrame:
    """``(seq, id, tags ARRAY<STRUCT>, _corrupt)`` of ``(seq, value)`` lines. Blank and
    NULL lines are skipped; an id alone is an item without tags. One bad tag makes its whole
    line bad: ``failfast`` ends the job, ``permissive`` keeps the line in ``_corrupt`` with
    the rest NULL, ``dropmalformed`` leaves it out."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    raw = lines.select(F.col(seq).alias("seq"), F.col(text).alias("line")).filter(F.col("line").rlike(f"[^{lex.WHITE_SPACE}]"))
    def read(f: Column) -> Column:
        found = tag_columns(F.slice(f, 2, F.greatest(F.size(f), F.lit(1))))
        whole = lambda tags: F.struct(F.get(f, F.lit(0)).alias("id"), tags.alias("tags"), F.coalesce(F.forall(tags, lambda t: t["key"].isNotNull()), F.lit(False)).alias("good"))
        return F.get(F.transform(F.array(found), whole), F.lit(0))

    # The generator keeps filters on its result above it, so a line is read once.
    parsed = raw.select("seq", "line", F.explode(F.transform(F.array(split_column(F.col("line"))), read)).alias("p")).select("seq", "line", "p.*")
    good = F.col("good")
    if mode == "failfast":
        checked = F.when(good, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.col("line"))).cast("string"))
        return parsed.select("seq", checked.alias("id"), "tags", F.lit(None).cast("string").alias("_corrupt"))
    if mode == "dropmalformed":
        return parsed.filter(good).select("seq", "id", "tags", F.lit(None).cast("string").alias("_corrupt"))
    keep = lambda c: F.when(good, F.col(c)).alias(c)
    return parsed.select("seq", keep("id"), keep("tags"), F.when(~good, F.col("line")).alias("_corrupt"))


def to_writes(parsed: DataFrame) -> DataFrame:
    """The write log of parsed lines: each line is one batch."""
    rows = parsed.filter(F.col("id").isNotNull()).select("seq", "id", F.posexplode("tags").alias("pos", "tag"))
    return rows.select("seq", "pos", "id", "tag.ns", "tag.key", "tag.value")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``(seq, value)`` of text files, numbered from 0 by file name and place in the file.
    Splits are counted first and their offsets summed: one number per split is gathered,
    never the lines."""
    rows = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    starts = rows.groupBy("file_path", "file_block_start").agg(F.min("n").alias("low"), F.count("*").alias("c"))
    before = Window.orderBy("file_path", "file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = starts.select("file_path", "file_block_start", "low", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    numbered = rows.join(F.broadcast(offsets), ["file_path", "file_block_start"])
    return numbered.select((F.col("n") - F.col("low") + F.col("offset")).alias("seq"), "value")


def read_lines(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    return parse_lines(read_text(spark, path), mode)


def read_jsonl(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    """Nested items from JSON lines ``{"id": …, "tags": [{"ns":…, "key":…, "value":…}]}``.
    A missing part is absent; the schema is fixed, never guessed."""
    return spark.read.schema(NESTED).json(path, mode=mode.upper())


def write_jsonl(nested: DataFrame, path: str, mode: str = "error") -> None:
    nested.select("id", "tags").write.mode(mode).json(path)


def read_writes(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet write log; other columns of the files aren't read."""
    return spark.read.parquet(path).select(*WRITES.fieldNames())


def lines_of(spark: SparkSession, lines: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(write log, items) of lines at hand, such as standard input. Blank ones are skipped;
    the first bad one raises."""
    rows, ids = [], []
    for seq, line in enumerate(lines):
        if not lex.split_fields(line):
            continue
        id, tags = parse_line(line)
        ids.append((id,))
        rows += [(seq, pos, id, t.ns, t.key, t.value) for pos, t in enumerate(tags)]
    return spark.createDataFrame(rows, WRITES), spark.createDataFrame(ids, "id string")


def quoted(text: Column) -> Column:
    """A token's spelling: bare where the grammar allows it, else quoted."""
    bare = text.rlike(f"\\A{lex.BARE}\\z") & (text != "+")
    return F.when(bare, text).otherwise(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')))


def spell(ns: Column, key: Column, value: Column) -> Column:
    """A tag in the write grammar; reading it back gives the same triple."""
    return F.concat(
        F.coalesce(F.concat(quoted(ns), F.lit(":")), F.lit("")), quoted(key), F.coalesce(F.concat(F.lit("="), quoted(value)), F.lit(""))
    )


def to_lines(nested: DataFrame) -> DataFrame:
    """One line per nested item. The id stands as it is, so it must be free of white space
    and quotes; others are refused, as they couldn't be read back."""
    id = F.when(F.col("id").rlike(f'\\A[^"{lex.WHITE_SPACE}]+\\z'), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("no id for a line: "), F.coalesce("id", F.lit("NULL")))).cast("string"))
    tags = F.transform(F.coalesce("tags", F.array().cast(NESTED["tags"].dataType)), lambda t: spell(t["ns"], t["key"], t["value"]))
    spelled = F.transform(F.array(tags), lambda t: F.when(F.size(t) > 0, F.concat(id, F.lit(" "), F.array_join(t, " "))).otherwise(id))
    return nested.select(F.explode(spelled).alias("value"))  # a generator, so that it is spelled once


def write_ids(ids: DataFrame, path: str, mode: str = "error") -> None:
    """Result sink: one id per line, in order across the part files."""
    ids.select("id").orderBy("id").write.mode(mode).text(path)


def joined_ids(ids: DataFrame) -> str:
    """All ids as one text, a line each: for an edge that shows a result whole."""
    return "\n".join(r["id"] for r in ids.orderBy("id").toLocalIterator())

