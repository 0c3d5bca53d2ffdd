"""Every query of the core with SQL gives the SQL's rows, and all run, on the smallest tables."""

import glob
import os
import re
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry_module  # noqa: E402
from tagloom import catalog  # noqa: E402

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


def test_names():
    assert set(SQL) <= set(QUERIES) and set(catalog.QUERIES) <= set(QUERIES)
    assert {"p1_found", "p4_found", "p5_found"} <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(same_rows, name):
    same_rows(QUERIES[name], SQL.get(name))


def test_entry(spark, sf):
    assert entry_module.entry(spark).columns == ["id"]


def test_results_are_sorted(spark, sf):
    ids = [r.id for r in QUERIES["universe"](spark, sf).collect()]
    assert ids == sorted(set(ids), key=str.encode)


def test_bucketed_queries_read_their_buckets(spark, sf):
    def scans(name):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "PartitionFilters" in line]

    for name in ("bucketed_key", "bucketed_point", "bucketed_range", "bucketed_typed", "bucketed_and_not", "bucketed_or", "bucketed_posting"):
        assert scans(name) and all(re.search(r"PartitionFilters: \[[^]]*tag_bucket", s) for s in scans(name)), scans(name)
    # What has to be read whole is read once.
    assert len(scans("bucketed_complement")) == 1


def test_a_log_is_filtered_before_its_collapse(spark, sf):
    """Every scan of the log meets the places that the query names."""
    plan = QUERIES["writes_query"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    log = [part for part in plan.split("Filter ")[1:] if "Relation" in part.split("Filter ")[0]]
    assert len(log) >= 3 and all("= owner" in part and "= state" in part for part in log)


def test_the_core_stands_alone():
    """Nothing outside the subpackage imports it, but the entry, which may do without."""
    for path in glob.glob(f"{ROOT}/tagloom/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            with open(path) as f:
                assert "tagloom.llm" not in f.read(), path


@pytest.mark.parametrize("missing,works", [("tagloom.llm", True), ("numpy", False)])
def test_the_entry_without_the_subpackage(missing, works):
    """Without it the core's queries are left; what it lacks itself is an error."""
    code = f"""
import sys
from importlib.abc import MetaPathFinder
from tagloom import catalog
for name in [m for m in sys.modules if m == {missing!r} or m.startswith({missing!r} + ".")]:
    del sys.modules[name]
class Hide(MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__
assert set(__spark_entry__.queries()) == set(catalog.QUERIES)
assert set(__spark_entry__.oracle_sql()) == set(catalog.SQL)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    if works:
        assert done.returncode == 0, done.stderr
    elif os.path.isdir(f"{ROOT}/tagloom/llm"):
        assert done.returncode != 0 and f"No module named '{missing}'" in done.stderr
