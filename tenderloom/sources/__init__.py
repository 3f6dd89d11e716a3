"""Readers, writers and the adapters for files and models."""
