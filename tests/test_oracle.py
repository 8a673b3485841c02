"""Every registered query against its DuckDB formulation (driver contract)."""

import pytest

from tests.conftest import SF_SMALL

import __spark_entry__ as E
from tools.check_oracle import compare, duck

def own(names):
    """Without the optional training-data queries, which have their own tests."""
    return [n for n in names if n != "pipeline" and not (n.startswith("op") and n[2].isdigit())]


NAMES = own(E.queries())
SQL = {n: E.oracle_sql()[n] for n in own(E.oracle_sql())}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_oracle_or_is_marked():
    assert sorted(set(NAMES) - set(SQL)) == []
    assert set(SQL) <= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, E.queries()[name], SQL.get(name), SF_SMALL)
    assert res.get("ok") is not False, res


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 16
    assert df.columns[:3] == ["row_id", "base_precision", "quant_precision"]
