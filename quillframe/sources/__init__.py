"""Readers, writers and generated data."""
