"""Structured Streaming jobs for incremental upkeep."""
