"""strata.sinks."""
