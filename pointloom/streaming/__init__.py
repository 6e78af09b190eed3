"""Streams of query points against a static reference cloud."""
