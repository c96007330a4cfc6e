"""Every registered query: against its SQL where it has one, else that it runs and gives rows."""

import pytest

import __spark_entry__
from tidemark.plans import ENTRIES, recommender_queries
from tidemark.plans.recommend import Recommender
from tests.compare import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.fixture(scope="module", autouse=True)
def one_recommender(spark, data):
    """The steps that the queries share are computed once."""
    shared = Recommender(spark, data)
    patch = pytest.MonkeyPatch()
    patch.setattr(recommender_queries, "Recommender", lambda s, d: shared)
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, data, con, name):
    entry = ENTRIES[name]
    frame = entry.run(spark, data)
    if entry.sql:
        same(frame, con, entry.sql)
    else:
        assert frame.count() > 0


def test_entry_and_registry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(5).count() == 5
