"""Stateful semantics over time: rate limits, caches and progress, for streams and as batches of the same."""
