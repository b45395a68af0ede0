"""Incremental versions of the aggregates."""
