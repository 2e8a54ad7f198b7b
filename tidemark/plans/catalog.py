"""Importing this module registers every query."""

from tidemark.plans import aggregation, assurance, evaluation, live, market, tabular, windows  # noqa: F401
from tidemark.plans.registry import QUERIES, TWINS  # noqa: F401
