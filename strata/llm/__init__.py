"""Operators for large training-data pipelines.  Nothing else in the library
imports this package; its queries are in :mod:`strata.llm.queries`."""
