"""Structured Streaming forms: resumable batches over files, and the event stream of finished requests."""
