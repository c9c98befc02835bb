"""Structured Streaming forms of resampling and exits."""
