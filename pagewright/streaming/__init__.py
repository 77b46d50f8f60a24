"""Incremental processing of result files."""
