"""Every query with SQL gives the SQL's rows; the others run and keep their schema."""

import importlib

import pytest

from tests.conftest import DATA, agrees

MODULES = [importlib.import_module(f"genoquery.plans.{m}") for m in ("data_queries", "scalar_queries", "relational_queries", "source_queries", "api_queries")]


@pytest.mark.parametrize(("module", "name"), [(m, n) for m in MODULES for n in m.oracle_sql()], ids=lambda x: x if isinstance(x, str) else "")
def test_same_rows_as_sql(spark, duck, module, name):
    agrees(spark, duck, module, name)


@pytest.mark.parametrize(("module", "name"), [(m, n) for m in MODULES for n in m.queries() if n not in m.oracle_sql()], ids=lambda x: x if isinstance(x, str) else "")
def test_runs(spark, module, name):
    df = module.queries()[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_entry_needs_no_optional_part(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
