"""Queries over the driver's tables, one per operator, with their SQL twins."""

from . import reading, replicating, storing, transacting  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
