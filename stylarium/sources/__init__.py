"""Scans and sinks: JSON Lines records, guarded texts, vectors with provenance, reports, written intermediate tables."""
