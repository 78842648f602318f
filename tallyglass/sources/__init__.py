"""Readers, writers, schemas and the bindings of the test tables."""
