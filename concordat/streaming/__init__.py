"""Structured Streaming forms of the integration operators."""
