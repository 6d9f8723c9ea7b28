import pytest

from rankweave.llm.queries import QUERIES
from rankweave.llm.sql import ORACLES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, data, name):
    compare(spark, data, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_kept_documents_are_named(spark, data):
    rows = QUERIES["p9_kept"](spark, data).collect()
    assert {"kept"} < {r["why"] for r in rows} <= {"kept", "slot", "hint", "filler", "notice"}
    assert sum(r["documents"] for r in rows) == spark.read.parquet(f"{data}/documents.parquet").count()
