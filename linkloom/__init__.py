"""Structural analytics on Spark: dependency graphs, liveness, similarity, conventions and edit planning."""
