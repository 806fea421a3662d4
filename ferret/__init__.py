"""ferret: resource-page analysis and ranked search as Spark DataFrame jobs.

Sub-packages
    sources    table readers, test-table adapters, upsert/replace sinks
    functions  Column-expression helpers (text, HTML regexes, the one Python HTML walk)
    operators  DataFrame -> DataFrame operators: extract, predicates, classify,
               search, reports, frontier
    plans      composed driver queries and their DuckDB oracle SQL
    streaming  Structured Streaming jobs (live feed, percolation, per-client dedupe)
"""

__all__ = ["session"]
