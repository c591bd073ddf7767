import pytest

import __spark_entry__
from gridloom import registry
from tests.oracle import compared, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(n for n in registry.queries() if n.endswith("_embeddings")) + ["compression_summary_lineitem_fine", "pattern_dictionary_lineitem", "voxel_counts_events"])
def test_query(spark, con, name):
    ours, theirs = compared(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name])
    assert ours == theirs and ours


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(registry.oracle_sql()) == set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
