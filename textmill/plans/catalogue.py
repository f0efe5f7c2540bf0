"""Every query of the engine and its SQL."""

from __future__ import annotations

from textmill.plans import answers, evaluation, events, experiments, extended, grades, ingestion, retrieval, rules, served, service, synthesis, units  # noqa: F401
from textmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
