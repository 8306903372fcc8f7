"""Readers, the versioned table store and the inputs derived from the benchmark tables."""
