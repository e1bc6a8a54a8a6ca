"""stagehand — raw → staged → checked behaviour analytics, expressed as Spark jobs.

Layers:
  sources/    all-string raw scans (CSV, XML pages) and raw writes
  functions/  column expressions: guarded casts, null rules, list-literal parsing
  operators/  DataFrame → DataFrame building blocks: quality checks, staging,
              reshape, ingest state, sampling
  plans/      composed analyses (marts) and the registered driver queries
  streaming/  incremental landing with Structured Streaming
"""

__version__ = "0.1.0"
