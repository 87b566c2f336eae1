"""Operators on long cells, dense vectors and predictions."""
