import pytest

from gridloom.llm import registry
from tests.oracle import compared, connection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    ours, theirs = compared(registry.queries()[name](spark, SF), connection(SF), registry.oracle_sql()[name])
    assert ours == theirs and ours


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
