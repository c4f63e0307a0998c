"""Structured Streaming views of the append-only ledgers."""
