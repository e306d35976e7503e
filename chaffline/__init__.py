"""Rank, prune and audit training corpora held in Spark tables."""
