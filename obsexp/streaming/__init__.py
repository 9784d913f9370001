"""Structured Streaming forms of the ingest, deduplication, aggregation and claim operators."""
