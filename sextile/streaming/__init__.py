"""Streaming forms of scoring and of the daily figures."""
