"""Corpus queries against their DuckDB twins."""

import pytest
from compare import assert_same

from stratoloom.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, small, duck, name):
    """The query and its twin agree."""
    assert_same(QUERIES[name](spark, small), duck.execute(ORACLES[name]).df())


def test_all_thirteen():
    """One query for each operator."""
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
