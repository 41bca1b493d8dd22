"""Every registered query gives the rows of its SQL."""

import pytest

from docweave.jobs.catalogue import ORACLES, QUERIES
from tests.conftest import DATA, rows


@pytest.mark.parametrize("name", QUERIES)
def test_query_and_sql_agree(spark, duck, name):
    found = QUERIES[name](spark, str(DATA / "sf0.001")).toPandas()
    assert rows(found) == rows(duck.execute(ORACLES[name]).df())
