"""The driver's contract."""

import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from siltstone.plans import catalog
from tests.conftest import ROOT


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_the_rest_stands_without_the_corpus_operators(tmp_path, also):
    shutil.copytree(ROOT / "siltstone", tmp_path / "siltstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *also]:
        shutil.copy(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLE_SQL))], out.stderr
