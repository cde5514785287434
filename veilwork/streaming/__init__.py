"""Incremental sync and change application."""
