"""Readers, session views and sinks."""
