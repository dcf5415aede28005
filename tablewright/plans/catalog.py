"""Imports every query module, which fills the registry."""

from tablewright.plans import (  # noqa: F401
    queries_business,
    queries_charts,
    queries_governance,
    queries_learning,
    queries_quality,
    queries_relational,
    queries_stats,
    queries_streaming,
    queries_tests,
    queries_timeseries,
)
