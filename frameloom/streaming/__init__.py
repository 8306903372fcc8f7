"""Structured Streaming surface: change feed, deletion feed, fingerprint feed."""
