"""All named queries."""

from tidemark.plans import history, metrics, mining, parsing, pools, priors, rules  # noqa: F401
from tidemark.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
