"""Readers, schemas and the shared scratch space."""
