"""Every registered query against its DuckDB statement on the smoke tables."""

import pytest

from sanscope.checks.compare import compare, duck
from sanscope.plans.registry import ORACLE, QUERIES, load_all

load_all()
KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, sf, con, key):
    assert key in ORACLE
    r = compare(spark, key, sf, con)
    assert r["status"] == "OK", r


def test_entry_smoke(spark):
    import importlib.util
    import os

    spec = importlib.util.spec_from_file_location(
        "spark_entry", os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.columns == ["domain", "level", "first_seen", "last_seen", "is_active"]
    assert df.count() > 0
    assert set(mod.oracle_sql()) <= set(mod.queries())
    assert set(KEYS) <= set(mod.oracle_sql())
