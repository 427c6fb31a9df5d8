"""Readers, sinks and integrity checks."""
