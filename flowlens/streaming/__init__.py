"""Structured Streaming forms of the alert operators."""
