"""Scans, sinks and domain views."""
