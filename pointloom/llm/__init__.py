"""Operators for large training-data pipelines; nothing else in the library imports this subpackage."""
