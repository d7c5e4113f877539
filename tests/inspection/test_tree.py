"""A folder tree with all the cases a listing meets, against a plain walk."""

import os

import pytest
from pyspark.sql import functions as F

from tamis.plans.default_rules import DEFAULT_RULES as RULES
from tamis.sources.files import inspect_files, scan_files
from tamis.sources.tree import file_tree


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for name, size in {"a.txt": 5, ".env": 7, "empty": 0, "b/c.log": 30, "b/.hidden/d": 9, ".git/config": 11, "_x/y.json": 12, "b/deep/er/z é.txt": 100, "b/deep/,odd": 3}.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    os.symlink(top / "a.txt", top / "link")
    os.symlink(top / "b", top / "loop")
    (top / "nothing").mkdir()
    return top


def plainly(top, hidden=False, recursive=True):
    out = {}
    for folder, below, names in os.walk(top):
        below[:] = [d for d in below if (hidden or not d.startswith(".")) and not os.path.islink(f"{folder}/{d}") and recursive]
        out |= {os.path.join(folder, n): os.path.getsize(os.path.join(folder, n)) for n in names if not os.path.islink(os.path.join(folder, n))}
    return out


@pytest.mark.parametrize("tasks", [1, 4, 200])
def test_listing(spark, tree, tasks):
    top = str(tree)
    of = lambda df: {r["path"]: r["length"] for r in df.collect()}
    assert of(file_tree(spark, top, tasks=tasks)) == plainly(top)
    assert of(file_tree(spark, top, tasks=tasks, includeHidden=True)) == plainly(top, hidden=True)
    assert of(file_tree(spark, top, tasks=tasks, recursive=False)) == plainly(top, recursive=False)
    assert of(file_tree(spark, f"{top}/nothing", tasks=tasks)) == of(file_tree(spark, f"{top}/absent", tasks=tasks)) == {}
    assert of(file_tree(spark, f"file://{top}", tasks=tasks)) == plainly(top)
    assert of(file_tree(spark, f"{top}/a.txt", tasks=tasks)) == {f"{top}/a.txt": 5}
    rows = file_tree(spark, top, tasks=tasks).collect()
    assert all(r["content"] == b"x" * r["length"] and r["modificationTime"] for r in rows)


def test_limits_are_met_while_listing(spark, tree):
    top, every = str(tree), plainly(str(tree))
    of = lambda df: {r["path"] for r in df.collect()}
    files = file_tree(spark, top)
    assert of(files.where("length <= 30 and length > 5")) == {p for p, n in every.items() if 5 < n <= 30}
    assert of(files.where("length = 0")) == {f"{top}/empty"}
    assert of(files.where(F.col("path").endswith(".txt") & F.col("path").startswith(f"{top}/b"))) == {f"{top}/b/deep/er/z é.txt"}
    plan = files.where("length <= 30")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (length" not in plan and "length#" in plan
    assert of(scan_files(spark, top, max_read_bytes=10)) == {f"file:{p}" for p, n in every.items() if n <= 10}
    assert of(scan_files(spark, top, skip_suffix=".txt")) == {f"file:{p}" for p in every if not p.endswith(".txt")}
    walk = [f"file:{top}/{p}" for p in (".env", "_x/y.json", "a.txt", "b/c.log")]
    assert of(scan_files(spark, top, max_files=4)) == set(walk)
    assert len(of(scan_files(spark, [f"{top}/b", f"{top}/_x"]))) == 4


def test_a_file_that_cannot_be_read_is_not_allowed(spark):
    frame = spark.createDataFrame([("a", 10, None), ("b", 0, b"")], "path string, length bigint, content binary")
    got = {r["path"]: (r["verdict"], r["note"]) for r in inspect_files(frame, RULES).collect()}
    assert got == {"a": ("ESCALATE", "cannot be read"), "b": ("ALLOW", None)}
