"""Readers, writers and the backends at the edge."""
