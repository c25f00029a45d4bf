"""Operators over tables: retrieval, statistics, sampling, chunking, lexicons, leaks, gates, the loop's parts."""
