"""Patterns in execution traces, found and verified with Spark."""

__version__ = "0.1.0"
