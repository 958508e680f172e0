"""Registered queries: name -> (query, SQL with the same result or None)."""

from workload import file_queries, profile_queries, registry_queries, report_queries

ENTRIES = {
    **file_queries.ENTRIES,
    **profile_queries.ENTRIES,
    **registry_queries.ENTRIES,
    **report_queries.ENTRIES,
}
