"""Readers and writers: captured tables, the paged API, lookup tables, the state log, sinks, settings."""
