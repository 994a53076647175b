"""Structured Streaming forms of the lookup and the intake."""
