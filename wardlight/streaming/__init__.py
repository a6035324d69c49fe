"""Structured Streaming versions of the journal, duplicate and scoring jobs."""
