"""Structured Streaming jobs: resource stream, fan-out, percolation, live dedupe."""
