"""Preprocessing and classical learning as Spark aggregates and column expressions."""
