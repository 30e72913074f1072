"""Readers, ingest jobs and writers."""
