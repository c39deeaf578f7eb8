"""The stored catalog, its fixed queries and the ingestion that fills it."""
