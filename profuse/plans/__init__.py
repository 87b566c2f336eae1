"""Whole workflows and the catalogue of queries with their SQL twins."""
