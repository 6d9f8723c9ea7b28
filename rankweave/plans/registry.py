"""Queries by name, each with the SQL that DuckDB answers alike where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankweave.operators.corpus import Corpus, corpus
from rankweave.plans.prefix import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Registers a function of a corpus under a name."""

    def register(make: Callable[[Corpus], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(corpus(spark, sf_dir))

        run.__name__, run.__doc__ = name, make.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql, extra)
        return make

    return register
