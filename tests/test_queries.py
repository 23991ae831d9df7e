"""Every registered query against its SQL in DuckDB, on the driver's smallest tables."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from millrace.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(round(float(value), 6)) if isinstance(value, int | float) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    rows = [dict(zip(columns, r, strict=True)) for r in found.fetchall()]
    assert sorted(columns) == sorted(df.columns)
    assert got == sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in rows)


def test_entry_without_the_training_data_operators(tmp_path):
    """The package's other parts do not need them."""
    root = Path(__file__).parent.parent
    shutil.copytree(root / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'agg_basic' in e.queries() and not any(n.startswith('op') for n in e.queries()); assert e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=False)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("gone", ["folder", "dependency"])
def test_entry_survives_with_the_pipeline_in_place(tmp_path, gone):
    """The llm folder, or something that it needs, is missing, and corpus_pipeline.py is not."""
    root = Path(__file__).parent.parent
    if not (root / "corpus_pipeline.py").exists():
        pytest.skip("no pipeline here")
    shutil.copytree(root / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns(*(["llm"] if gone == "folder" else []), "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path)
    if gone == "dependency":
        (tmp_path / "ahocorasick.py").write_text("raise ImportError('taken away', name='ahocorasick')")
    code = "import __spark_entry__ as e; assert 'agg_basic' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); assert e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=False)
    assert done.returncode == 0, done.stderr
    assert ("taken away" in done.stderr) == (gone == "dependency")


def test_nothing_else_imports_them():
    root = Path(__file__).parent.parent / "millrace"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "millrace.llm" not in f.read_text(), f
