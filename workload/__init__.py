"""Registered queries over the driver's tables."""

from workload import (  # noqa: F401
    catalog_queries,
    data_queries,
    feature_queries,
    profile_queries,
    score_queries,
)
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
