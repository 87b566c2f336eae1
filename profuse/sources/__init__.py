"""Readers, writers and the stand-in profiles built from the given tables."""
