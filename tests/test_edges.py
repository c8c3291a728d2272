"""Every query of the scanner on messy and on empty tables."""

import pytest

from textward.plans import queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_messy_and_empty(spark, messy, empty, name):
    query = queries.queries()[name]
    rows = query(spark, messy).collect()
    again = query(spark, messy).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    out = query(spark, empty)
    assert out.columns == query(spark, messy).columns
    if name not in ("hits_rollup", "signature_layers", "p2_gap_settings"):
        assert out.collect() == []


def test_actors(spark, messy):
    """One address in several spellings is one caller; blank keys and rows without time don't count."""
    rows = {(r.actor, r.first_audit_id, r.last_audit_id) for r in queries.queries()["p2_found"](spark, messy).collect()}
    assert rows == {("10.0.0.1", 0, 1), ("10.0.0.1", 5, 5), ("key", 4, 4)}
