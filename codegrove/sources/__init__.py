"""Scans, stored tables, sinks and model hooks."""
