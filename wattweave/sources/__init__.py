"""Sources, sinks and ingestion jobs."""
