"""Every registered query against its SQL twin on the smallest data."""

import pytest

import __spark_entry__ as entry
from ratescale.catalog.registry import REGISTRY
from tools.verify import compare, connect

# the corpus queries have tests of their own
QUERIES = {name: build for name, build in entry.queries().items() if name in REGISTRY}
TWINS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data, name):
    state, n, _, note = compare(spark, con, data, name, QUERIES[name], TWINS.get(name))
    assert n and state == ("ok" if name in TWINS else "rows"), note or state


def test_only_unsupported_queries_lack_a_twin():
    assert set(QUERIES) - set(TWINS) == {"h6_text_predictor", "h6_vector_predictor", "h7_grid_choice"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["person_term", "mean", "std", "count"] and df.count() == 4
