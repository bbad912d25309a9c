"""Readers, schemas and the snapshot store."""
