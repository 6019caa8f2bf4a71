"""Every query with an oracle gives the rows of its SQL; every other one runs with a stable schema."""

import oracle
import pytest
from conftest import SMALL
from quillspan.plans import alignment, annotation, curation, dictionary, front_matter, ner, records, reports, review, stores, text, web  # noqa: F401
from quillspan.plans.views import with_views
from quillspan.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    assert oracle.difference(QUERIES[name](spark, SMALL), con, with_views(ORACLES[name])) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.count() >= 0 and df.schema == QUERIES[name](spark, SMALL).schema


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
