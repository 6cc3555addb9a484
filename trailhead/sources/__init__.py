"""Readers of files and adapters of tables."""
