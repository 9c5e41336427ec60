"""Readers and writers of the two binary formats: log files and sorted files, as Python data sources."""

from .formats import LogSource, SortedSource, register

__all__ = ["LogSource", "SortedSource", "register"]
