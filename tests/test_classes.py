"""Queries on pairs meet classes of persons: none makes a row for every pair of the pool."""

import pytest

from pairstone.operators import matching
from pairstone.plans import catalogue
from test_queries import SF

BY_CLASS = ["pool_summary", "level_histogram", "pool_distribution", "explanations", "rank_recipients", "rank_donors"]


@pytest.mark.parametrize("name", BY_CLASS)
def test_no_row_for_every_pair(spark, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("a row for every pair")

    monkeypatch.setattr(matching, "possible_pairs", refuse)
    assert catalogue.QUERIES[name](spark, SF).columns
