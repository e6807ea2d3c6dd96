"""Every query with SQL gives what DuckDB gives on the same tables; the others run."""

import pytest

from scorelake.plans import catalogue
from tests.conftest import DATA, cells


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name not in catalogue.ORACLES:
        assert len(found.columns)
        return
    wanted = duck.execute(catalogue.ORACLES[name]).fetchdf()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert cells(found) == cells(wanted)
