import pytest

from maskwell.plans import catalogue
from oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
#: Gates that must find nothing.
EMPTY = {"leak_gate_violations", "resolution_gate_violations", "mint_phone_pool_guard", "pass_gate"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    rows = assert_same(spark, con, SF, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])
    assert rows > 0 or name in EMPTY


def test_every_query_has_sql_or_a_test():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"positional_noise", "blind_index_hmac", "novel_names"}
