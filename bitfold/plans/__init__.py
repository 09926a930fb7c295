"""Whole evaluation jobs: estimation accuracy, retrieval quality, sampled errors, truth."""
