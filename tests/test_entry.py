"""The driver contract with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as E
from tally.plans.catalog import QUERIES
from tally.plans.oracle import ORACLE

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_core_queries_are_registered():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("gone", [("tally/llm", "tests/llm", "corpus_pipeline.py"), ("tally/llm", "tests/llm")])
def test_without_the_subpackage(tmp_path, gone):
    """A copy without the folders imports, registers the core queries and collects every other test."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda d, names: [
        n for n in names if n in (".git", "__pycache__", ".pytest_cache") or os.path.relpath(os.path.join(d, n), ROOT) in gone])
    (copy / "tally" / "llm" / "__pycache__").mkdir(parents=True)  # what a deleted package may leave behind
    env = {**os.environ, "PYTHONPATH": str(copy)}
    code = "import __spark_entry__ as E; print(sorted(E.queries()) == sorted(E.QUERIES), len(E.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert got.stdout.split() == ["True", str(len(ORACLE))], got.stderr
    got = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=copy, env=env, capture_output=True, text=True, timeout=180)
    assert got.returncode == 0, got.stdout


def test_a_broken_subpackage_is_an_error(tmp_path):
    """Only a subpackage that isn't there is left out; a module missing from it is not."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    package = copy / "tally" / "llm"
    package.mkdir(exist_ok=True)
    (package / "__init__.py").write_text("")
    (package / "queries.py").write_text("from tally.llm import nothing_of_that_name_here\nimport tally.llm.missing\n")
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)},
                         capture_output=True, text=True, timeout=120)
    assert got.returncode != 0 and "Error" in got.stderr
