"""Column expressions: hashing, bit sketches, similarities, estimators, scores."""
