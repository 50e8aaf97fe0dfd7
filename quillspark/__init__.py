"""Markdown corpora as DataFrames: one parse into a flat node table, everything else a query."""

__version__ = "0.1.0"
