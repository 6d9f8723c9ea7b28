"""Every query with SQL against DuckDB on the smallest data folder; the others must run."""

import pytest

from rankweave.plans import core
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_same_as_sql(spark, data, name):
    compare(spark, data, core.QUERIES[name], core.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_runs(spark, data, name):
    assert core.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["instance_id", "rank", "node", "file", "kind", "hops", "via", "lexical", "reached_by"]
    assert df.count() > 0
