"""The driver contract, with and without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from wayline.plans.oracle import ORACLE
from wayline.plans.queries import QUERIES

ROOT = Path(__file__).resolve().parents[1]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def without_folders(tmp_path, code):
    """What code says in a copy of the repository without the training-data folders and the pipeline."""
    shutil.copytree(ROOT / "wayline", tmp_path / "wayline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, *code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=1500)
    assert said.returncode == 0, said.stdout + said.stderr
    return said.stdout


def test_imports_without_the_training_data_folders(tmp_path):
    n, sql = without_folders(tmp_path, ["-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"]).split()
    assert int(n) == len(QUERIES) and int(sql) == len(ORACLE)


def test_the_rests_tests_pass_without_the_training_data_folders(tmp_path):
    said = without_folders(tmp_path, ["-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests", "--ignore", "tests/test_entry.py"])
    assert " passed" in said and "failed" not in said


def test_the_rest_works_where_the_training_data_cannot_be_imported(tmp_path):
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "corpus_pipeline.py").write_text("import a_library_that_is_not_there\n")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=broken, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": f"{broken}:{ROOT}"}, timeout=60)
    assert said.returncode == 0 and int(said.stdout) == len(QUERIES), said.stderr
