"""End-to-end plans: ingestion, search, evaluation."""
