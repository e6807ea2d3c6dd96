import pytest

from scorelake.llm import catalogue
from tests.conftest import DATA, cells


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DATA).toPandas()
    wanted = duck.execute(catalogue.ORACLES[name]).fetchdf()
    assert sorted(found.columns) == sorted(wanted.columns) and cells(found) == cells(wanted)
