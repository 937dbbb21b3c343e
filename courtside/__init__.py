"""Courtside: basketball statistics as Spark DataFrames.

Layers: ``sources`` (scans, sinks, driver-table adapters, saved pages),
``functions`` (Column -> Column expressions), ``operators`` (table builders
and skew-safe ordered operators), ``plans`` (the questions a user asks),
``streaming`` (incremental raw-document loads).
"""

__all__ = ["session"]
