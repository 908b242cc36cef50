"""strata: Bronze/Silver/Gold trip analytics as plain PySpark DataFrame code.

Every operator takes and returns a Spark DataFrame and is built only from
Spark built-in expressions, so Catalyst can prune, push down and codegen the
whole plan. Subpackages:

- ``functions``  Column-expression builders (casts, calendar, keys, labels)
- ``sources``    batch readers (Bronze files, lookup CSV, Silver, catalog)
- ``operators``  DataFrame -> DataFrame steps (enrich, filter, dims, quality,
                 upsert, aggregates, ordering, set operations)
- ``sinks``      writers (Silver append, Gold staging, quarantine, snapshots)
- ``plans``      composed jobs (Bronze->Silver, Silver->Gold, reports, runs)
- ``streaming``  incremental file ingest with Structured Streaming
"""

from strata.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
