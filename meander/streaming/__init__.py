"""Structured Streaming jobs: ingestion, buffers, rolling state, rollups."""
