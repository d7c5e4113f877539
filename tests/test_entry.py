"""The driver's entry points, with and without the subpackage that may be deleted."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names_of(root):
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout
    return [line.split() for line in out.splitlines()[-2:]]


def without_the_subpackage(root):
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "llm"))
    (root / "corpus_pipeline.py").unlink(missing_ok=True)
    return str(root)


def test_works_without_the_subpackage(tmp_path):
    root = without_the_subpackage(tmp_path / "repo")
    queries, oracle = names_of(root)
    assert "verdict" in queries and not [n for n in queries if n.startswith("op") or n == "pipeline"]
    assert set(oracle) <= set(queries)
    tests = [sys.executable, "-m", "pytest", "-q", "-x", *[f"tests/inspection/test_{n}.py" for n in ("regex", "validators", "pdf")]]
    subprocess.run(tests, cwd=root, env=os.environ | {"PYTHONPATH": root}, check=True, capture_output=True)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 200
