"""Readers, adapters from the driver tables, and table sinks."""
