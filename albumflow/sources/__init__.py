"""Readers and writers: listings, embedded metadata, JSON records, tracks, reports, files."""
