"""Structured Streaming jobs: file arrival, content dedup, idempotent loads, host anomalies."""
