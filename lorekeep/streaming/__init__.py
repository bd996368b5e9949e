"""Continuous ingest over Structured Streaming: an extension, as the operators themselves work on tables."""
