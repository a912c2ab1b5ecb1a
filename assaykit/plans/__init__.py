"""Registered queries over the given tables."""

from assaykit.plans import items, jobs, judged, pairs, search, texts  # noqa: F401
from assaykit.plans.registry import ORACLES, PLANS

__all__ = ["ORACLES", "PLANS"]
