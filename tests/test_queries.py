"""Every core query against its SQL; those that SQL cannot express give rows of a stable schema."""

import pytest
from conftest import DATA, compare

from tempora.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    compare(spark, duck, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    assert df.count() > 0
