"""Driver contract: entry runs, every oracle key has a query, names are unique."""

import importlib.util
import os

from tests.conftest import ROOT


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_smoke(spark):
    m = _entry()
    df = m.entry(spark)
    assert df.count() > 0
    assert "score" in df.columns and "url" in df.columns


def test_oracle_keys_subset_of_queries():
    m = _entry()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80
