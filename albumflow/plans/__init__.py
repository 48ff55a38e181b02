"""Whole pipelines, and the catalogue of queries over the driver's tables."""
