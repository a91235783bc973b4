"""All registered queries; importing a module registers its queries."""

from __future__ import annotations

from opinara.plans import analytics, answers, flows, labelling, statistics, texts, training  # noqa: F401
from opinara.plans.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
