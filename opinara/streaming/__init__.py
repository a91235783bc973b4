"""Incremental ingestion and live aggregates."""
