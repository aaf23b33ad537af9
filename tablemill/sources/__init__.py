"""Scans, sinks and page tables."""
