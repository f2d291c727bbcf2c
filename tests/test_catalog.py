"""Every registered query against its SQL counterpart."""

import pytest
from conftest import SF

import __spark_entry__ as entry
from check import compare, database

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    assert compare(got, con.execute(ORACLES[name]).df()) is None


def test_models_answer_every_row(spark):
    scored = QUERIES["gbt_score"](spark, SF)
    assert scored.count() == 16 * 720
    assert scored.filter("prediction is null or prediction < 0").isEmpty()


def test_entry(spark):
    assert not entry.entry(spark).isEmpty()
