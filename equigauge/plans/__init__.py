"""Pipelines and reports over the given tables."""
