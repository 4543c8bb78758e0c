"""Readers and derivations of the data model."""
