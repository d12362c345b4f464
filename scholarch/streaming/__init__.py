"""Structured Streaming forms of ingestion, progress, operation state, analytics and learning."""
