"""Spark-first text style, fidelity and retrieval analytics."""
