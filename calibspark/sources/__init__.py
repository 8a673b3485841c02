"""Readers, writers and the derived views over the given tables."""
