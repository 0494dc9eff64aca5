"""All registered queries. Importing the query modules fills the registry."""

from riskweave.plans import cases, drifts, features, gates, graphs, metrics, rounds, training  # noqa: F401
from riskweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
