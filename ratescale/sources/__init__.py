"""Readers, ingest checks and writers."""
