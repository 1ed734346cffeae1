"""The driver contract: what is registered runs, agrees with its SQL, and stands without the optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split() + ["embeddings"]
REPO = Path(entry.__file__).parent
OWN = sorted(k for k in entry.queries() if k.startswith("q_"))


def value(v):
    if v is None or v != v:
        return "NULL"
    return f"{v:.9g}" if isinstance(v, (float, Decimal)) else str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(value(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(OWN) >= 45


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [k for k in OWN if k in entry.oracle_sql()])
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    found = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())


def test_stands_without_the_optional_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 45 and not any(k.startswith('op') for k in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})
