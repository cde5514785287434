"""Scans, catalogs, policy documents, logs and sinks."""
