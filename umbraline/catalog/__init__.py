"""Registered queries over the given tables, each with its SQL twin where SQL can express it."""

from . import building, feeds, fieldwork, graphs, geography, intake, journeys, records, scoring, shadows  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
