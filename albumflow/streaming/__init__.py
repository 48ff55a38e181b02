"""Streaming forms of the pipeline."""
