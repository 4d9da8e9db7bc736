"""Structured Streaming: continuous ingest, one-time tokens, windows, expiring keys and a circuit breaker."""
