"""Compositions of the operators: evaluation runs, retrieval plans, the rewrite loop, experiments."""
