"""Readers, fixture views and sinks."""
