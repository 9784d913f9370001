"""Scans, sinks, the incremental-ingest ledger and the result manifest."""
