"""All queries of the core package."""

from rankweave.plans import evaluation, registry, retrieval, skew  # noqa: F401

QUERIES = {**skew.QUERIES, **registry.QUERIES}
ORACLES = {**skew.ORACLES, **registry.ORACLES}
