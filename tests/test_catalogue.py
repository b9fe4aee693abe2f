"""Each query has rows, and those of its SQL where it has some."""

import pytest

from chorale.plans import catalogue
from tests.conftest import DATA, rows


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    assert len(got) > 0
    if name in catalogue.ORACLE:
        assert rows(got) == rows(duck.execute(catalogue.ORACLE[name]).df())


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())
