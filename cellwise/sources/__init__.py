"""Scans, idempotent loads and sinks."""
