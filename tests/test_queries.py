"""Every registered query against its SQL over the whole tables."""

import pytest

from marginalia.plans import ORACLES, QUERIES
from oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], sf) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as e
    assert set(e.queries()) >= set(QUERIES)
    assert set(e.oracle_sql()) >= set(ORACLES)
    assert e.entry(spark).columns == ["doc_name", "section_tag", "chunks", "tag_rank", "in_top"]
