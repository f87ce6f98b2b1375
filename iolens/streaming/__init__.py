"""Structured Streaming forms of the rate operators."""
