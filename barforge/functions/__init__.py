"""Metrics and significance."""
