"""Readers. Layer schemas are explicit; nothing is inferred from data."""
