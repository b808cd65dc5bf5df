"""Every registered query against its SQL."""

from __future__ import annotations

import subprocess
import sys

import pytest
from compare import connect, differences

import __spark_entry__ as entry_module


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_equals_sql(spark, sf_dir, db, name):
    df = entry_module.queries()[name](spark, sf_dir)
    assert differences(df, db, entry_module.oracle_sql()[name]) is None


def test_every_own_query_has_sql():
    own = set(entry_module.queries()) - set(entry_module.LLM)
    assert own == set(entry_module.oracle_sql()) & own


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 10
    assert [r["similarity"] for r in rows] == sorted((r["similarity"] for r in rows), reverse=True)


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50"
    root = entry_module.__file__.rsplit("/", 1)[0]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
