"""Scans, series builders, fixtures and sinks."""

from .tables import read_table  # noqa: F401
