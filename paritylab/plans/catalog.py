"""Import every query module so that the registry is complete."""

from __future__ import annotations

from paritylab.plans import fairness_queries  # noqa: F401
from paritylab.plans import profile_queries  # noqa: F401
from paritylab.plans import mitigation_queries  # noqa: F401
from paritylab.plans import results_queries  # noqa: F401
from paritylab.plans import model_queries  # noqa: F401
from paritylab.plans import report_queries  # noqa: F401
from paritylab.plans import value_queries  # noqa: F401
from paritylab.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
