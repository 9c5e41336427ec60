"""Operators over the version log (key, version, value, deleted) and its relatives."""
