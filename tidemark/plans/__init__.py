"""Named queries with their SQL counterparts, kept in one registry."""

from tidemark.plans import cache, derived, pages, rating, samples, tabular, text  # noqa: F401
from tidemark.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
