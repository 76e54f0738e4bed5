"""Structured Streaming forms of review, dedup and usage summaries."""
