"""Every query of the fleet runs; those with SQL are compared in ``test_oracle``."""

import pytest

from fleetlife.plans import duckdb_sql, registry

WITHOUT_SQL = sorted(set(registry.QUERIES) - set(duckdb_sql.oracle_sql()))


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs(spark, sf, name):
    rows = registry.QUERIES[name](spark, sf).collect()
    assert rows
    if "status" in rows[0].asDict():
        assert {r.status for r in rows} == {"ok"}
