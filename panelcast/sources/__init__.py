"""Scans, sinks and stored models."""
