"""Column functions: labels, seeded hashes, scores."""
