"""DataFrame → DataFrame operators: quality checks, staging, reshape, ingest state, sampling."""
