"""Probabilistic record linkage as Spark jobs."""
