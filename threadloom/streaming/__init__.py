"""Structured Streaming forms of the case operators."""
