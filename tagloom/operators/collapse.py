"""The live state of a write log.

A key declared scalar keeps one value per item: the last one written. A declaration
counts for writes with a higher ``seq``, never for its own batch or earlier ones, so for
each item and target: if any governed write exists, the last governed value is the whole
state; otherwise all values written are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.config import ROOT_NS, arity_ns

#: Scalar targets up to which their list goes to every executor; more are joined by a shuffle.
MAX_TARGETS = 100_000


def scalar_targets(writes: DataFrame, root: str = ROOT_NS) -> DataFrame:
    """``(t_ns, t_key, since)``: the seq of the first scalar declaration of every target; a later
    ``set`` doesn't undo it."""
    said = writes.filter((F.col("ns") == arity_ns(root)) & (F.col("value") == "scalar") & F.col("key").isNotNull() & F.col("seq").isNotNull())
    # A target is split at its first colon.
    has_ns, colon = F.contains("key", F.lit(":")), F.instr("key", ":")
    name = F.when(has_ns, F.expr("substring(key, instr(key, ':') + 1)")).otherwise(F.col("key"))
    ns = F.when(has_ns, F.substring(F.col("key"), F.lit(1), colon - 1))
    return said.groupBy(ns.alias("t_ns"), name.alias("t_key")).agg(F.min("seq").alias("since"))


def small_targets(writes: DataFrame, root: str = ROOT_NS) -> DataFrame | None:
    """The scalar targets as a side to join: at hand and broadcast up to ``MAX_TARGETS``, else as
    they are. None if there are none."""
    targets = scalar_targets(writes, root)
    rows = targets.limit(MAX_TARGETS + 1).collect()
    if not rows:
        return None
    if len(rows) > MAX_TARGETS:
        return targets
    return F.broadcast(writes.sparkSession.createDataFrame(rows, targets.schema))


def live_tags(writes: DataFrame, root: str = ROOT_NS, places: Column | None = None) -> DataFrame:
    """Distinct ``(id, ns, key, value)`` after collapse.

    Each step is an aggregate with a map-side half, so neither a hot key nor a hot item
    meets in one task. Rows delivered twice and rows out of order don't matter. Rows
    without id or key are dropped; a write without ``seq`` counts as ungoverned.

    ``places``, a condition on ns and key, keeps those tags only. What a place holds follows
    from the writes to it alone, so the condition goes before the collapse, to the scans.
    """
    tag = ["id", "ns", "key", "value"]
    rows = writes.select("seq", "pos", *tag).filter(F.col("id").isNotNull() & F.col("key").isNotNull())
    small = small_targets(rows, root)
    if places is not None:
        rows = rows.filter(places)
    if small is None:
        return rows.select(*tag).distinct()
    marked = rows.join(small, F.col("ns").eqNullSafe(F.col("t_ns")) & (F.col("key") == F.col("t_key")), "left")
    governed = F.coalesce(F.col("seq") > F.col("since"), F.lit(False))
    spot = ["id", "ns", "key"]
    last = (
        marked.filter(governed).groupBy(*spot)
        .agg(F.max(F.struct("seq", F.coalesce("pos", F.lit(-1)).alias("pos"), "value")).alias("last"))
        .select(*spot, F.col("last.value").alias("value"))
    )
    free = marked.filter(F.col("since").isNull()).select(*tag)
    early = marked.filter(F.col("since").isNotNull() & ~governed).select(*tag).distinct()
    over = last.select(*[F.col(c).alias(f"o_{c}") for c in spot])
    kept = early.join(
        over,
        (F.col("id") == F.col("o_id")) & F.col("ns").eqNullSafe(F.col("o_ns")) & (F.col("key") == F.col("o_key")),
        "left_anti",
    )
    return free.distinct().unionByName(kept).unionByName(last)
