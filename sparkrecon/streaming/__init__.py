"""Structured Streaming aggregates for live status."""
