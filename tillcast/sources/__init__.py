"""Scans, the file catalogue and sinks."""
