"""Similarity culling on Spark: duplicates, scores, quotas and reports over large collections."""
