"""All registered queries outside the ``llm`` subpackage, with their SQL."""

from __future__ import annotations

from wardlight.plans import corpus, evidence, landed, normalize, readings, rules, sequences, services, snapshots, state, streams  # noqa: F401
from wardlight.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
