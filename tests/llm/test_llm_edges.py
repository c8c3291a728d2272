"""Every query of the training-data operators on messy and on empty tables."""

import pytest

from textward.llm import queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_messy_and_empty(spark, messy, empty, name):
    query = queries.queries()[name]
    rows = query(spark, messy).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, query(spark, messy).collect()))
    out = query(spark, empty)
    if name not in ("p8_shares",):
        assert out.collect() == []
