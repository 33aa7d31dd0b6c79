import pytest

from docmill.llm import registry
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert same(registry.QUERIES[name](spark, sf), connect(sf), registry.ORACLES[name]) > 0


def test_names():
    ops = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op"))
    assert ops == list(range(1, 14)) and "pipeline" in registry.QUERIES
