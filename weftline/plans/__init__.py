"""Runnable queries over the test tables, one or more per operator, with their SQL."""

from weftline.plans import (  # noqa: F401  (each module registers its queries)
    aggregation,
    flagship,
    joining,
    lineage,
    ordering,
    projection,
    scalar,
    sinks,
    sources,
    streaming,
    text,
)
from weftline.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
