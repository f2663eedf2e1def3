from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect
from veilscan.plans.oracle import ORACLE
from veilscan.plans.queries import QUERIES

NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


#: Approximate by nature; compared with brute force in tests/test_vector_index.py.
WITHOUT_SQL = {"vector_related"}


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES) - WITHOUT_SQL and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, name, sf_dir) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "total_findings", "risk_level", "risk_score", "risk_reason"]
    assert df.count() > 0


def test_entry_imports_without_the_optional_operators(tmp_path):
    here = Path(entry.__file__).resolve().parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if (here / name).exists():
            shutil.copy(here / name, tmp_path)
    shutil.copytree(here / "veilscan", tmp_path / "veilscan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e, bench; print(*sorted(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=True)
    assert said.stdout.split() == sorted(QUERIES)
