"""Whole pipelines and the storage helpers that cut their lineage."""
