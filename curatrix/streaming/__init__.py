"""Incremental jobs on Structured Streaming: keyed ingest and the review log."""
