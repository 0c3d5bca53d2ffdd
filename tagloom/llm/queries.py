"""Queries of the training-data operators, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import cooccur, encode, leaks, levels, setjoin, terms


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_column(_table(spark, d, "documents"))


def _stores(spark: SparkSession, d: str) -> list[DataFrame]:
    return [_table(spark, d, "items_nested"), _table(spark, d, "inbox_nested")]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.similar_pairs(_stores(spark, d))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.similarity_classes(_stores(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.found_pairs(_table(spark, d, "items_nested"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.surprising_pairs(_table(spark, d, "items_nested")).select("key_a", "key_b", "n_a", "n_b", "n_ab", "lift")


def p3_surprise(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.surprising_pairs(_table(spark, d, "items_nested"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_tags(_table(spark, d, "writes"))


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.all_terms(_table(spark, d, "writes"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaks(_table(spark, d, "documents"), _table(spark, d, "benchmark"))
    return found.select("doc_id", "item_id").distinct()


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return leaks.without_leaks(_table(spark, d, "documents"), _table(spark, d, "benchmark")).select("doc_id")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return levels.reading_levels(_table(spark, d, "documents"), _table(spark, d, "doc_levels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).filter("level IN (1, 4)").select("doc_id", "level").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p3_surprise": p3_surprise,
    "p6_found": p6_found,
    "p6_terms": p6_terms,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_clean": p8_clean,
    "p9_found": p9_found,
    "p9_levels": p9_levels,
}

_TAGS_ONCE = """
once AS (SELECT DISTINCT seq, pos, id, ns, key, value FROM writes),
n AS (SELECT count(DISTINCT id) AS ids FROM writes),
tag AS (
  SELECT coalesce(ns || ':', '') || key || coalesce('=' || value, '') AS term,
         count(*) AS occurrences, count(DISTINCT id) AS records
  FROM once GROUP BY ns, key, value),
marked AS (
  SELECT term, occurrences, records,
         CASE WHEN occurrences < 3 THEN 'rare' WHEN records > 0.08 * (SELECT ids FROM n) THEN 'common' END AS mark
  FROM tag)
"""

_PAIRS = """
has AS (SELECT DISTINCT id, t.key AS key FROM items_nested, unnest(tags) AS u(t) WHERE t.key IS NOT NULL),
total AS (SELECT count(*) AS n FROM items_nested),
per AS (SELECT key, count(*) AS n FROM has GROUP BY key),
joint AS (SELECT a.key AS key_a, b.key AS key_b, count(*) AS n_ab FROM has a JOIN has b ON a.id = b.id AND a.key < b.key GROUP BY 1, 2),
pair AS (
  SELECT key_a, key_b, x.n AS n_a, y.n AS n_b, n_ab, (SELECT n FROM total) AS n
  FROM joint JOIN per x ON x.key = key_a JOIN per y ON y.key = key_b)
"""

_SETS = """
record AS (SELECT id, tags FROM items_nested UNION ALL SELECT id, tags FROM inbox_nested),
tag AS (SELECT DISTINCT id, t FROM record, unnest(tags) AS u(t) WHERE id IS NOT NULL),
numbered AS (SELECT id, dense_rank() OVER (ORDER BY t.ns IS NULL, t.ns, t.key, t.value IS NULL, t.value) AS t FROM tag),
size AS (SELECT id, count(*) AS n, list_sort(list(t)) AS held FROM numbered GROUP BY id HAVING count(*) >= 5),
kept AS (SELECT id, t, n FROM numbered JOIN size USING (id)),
met AS (
  SELECT a.id AS id_a, b.id AS id_b, count(*) AS overlap, any_value(a.n) + any_value(b.n) - count(*) AS either
  FROM kept a JOIN kept b ON a.t = b.t AND a.id < b.id AND least(a.n, b.n) * 4 >= greatest(a.n, b.n) * 3 GROUP BY 1, 2),
similar_pair AS (SELECT id_a, id_b FROM met WHERE overlap * 4 >= either * 3)
"""

SQL: dict[str, str] = {
    "p2_found": f"WITH {_SETS} SELECT id_a, id_b FROM similar_pair",
    "p2_classes": f"""WITH {_SETS},
class AS (SELECT min(id) AS class_id, count(*) AS copies, list(id) AS ids FROM size GROUP BY held),
member AS (SELECT unnest(ids) AS id, class_id, copies FROM class),
link AS (
  SELECT DISTINCT a.class_id AS x, b.class_id AS y
  FROM similar_pair JOIN member a ON a.id = id_a JOIN member b ON b.id = id_b WHERE a.class_id <> b.class_id),
degree AS (SELECT c, count(DISTINCT other) AS links FROM (SELECT x AS c, y AS other FROM link UNION ALL SELECT y, x FROM link) GROUP BY c)
SELECT id, class_id, copies, coalesce(links, 0) AS links FROM member LEFT JOIN degree ON c = class_id""",
    "p3_found": f"""WITH {_PAIRS} SELECT key_a, key_b FROM pair
WHERE n_ab >= 5 AND n_ab * 1000 >= 4 * n AND CAST(n_ab AS HUGEINT) * n >= 3 * CAST(n_a AS HUGEINT) * n_b""",
    "p3_pairs": f"WITH {_PAIRS} SELECT key_a, key_b, n_a, n_b, n_ab, CAST(n_ab AS DOUBLE) * n / (CAST(n_a AS DOUBLE) * n_b) AS lift FROM pair",
    "p6_found": f"WITH {_TAGS_ONCE} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p6_terms": f"""WITH {_TAGS_ONCE},
part AS (
  SELECT 'ns' AS grain, ns AS term, id FROM once UNION ALL
  SELECT 'key', key, id FROM once UNION ALL
  SELECT 'value', value, id FROM once)
SELECT 'tag' AS grain, term, occurrences, records, mark FROM marked
UNION ALL
SELECT grain, term, count(*), count(DISTINCT id), NULL FROM part WHERE term IS NOT NULL GROUP BY grain, term""",
}
