"""Readers, adapters and snapshot sinks."""
