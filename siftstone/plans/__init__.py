"""Query model and query-string parser."""
