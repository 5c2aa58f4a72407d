"""Structured Streaming: dump tails, upserts, change fan-out, the work queue."""
